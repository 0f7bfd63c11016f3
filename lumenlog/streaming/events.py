"""Streams of canonical events.

Each function takes a streaming (or static) DataFrame of events and returns one; `idempotent_sink` writes micro-batches so that a batch that
runs twice, or an event that comes twice, adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import mask, short_hash
from ..operators.events import new_events
from ..schema import EVENT, severity_rank


def read_events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Events as they arrive as Parquet files in a folder, `files` of them a batch at most."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once: ids are kept as long as late data may come. Events without a time are left out."""
    return events.where("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "event_id"])


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    """events with a watermark; late None: they have one, as after `deduplicated`."""
    return events if late is None else events.withWatermark("ts", late)


def template_counts(events: DataFrame, width: str = "5 minutes", late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and highest severity rank of each masked template in tumbling windows, or sliding ones if slide is given."""
    rows = _watermarked(events, late).withColumn("template", mask("message"))
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy("case_id", span.alias("w"), "template").agg(F.count(F.lit(1)).alias("count"), F.max(severity_rank()).alias("rank"))
    return out.select("case_id", "w.start", "w.end", short_hash("template").alias("template_id"), "template", "count", "rank")


def bursts(events: DataFrame, gap: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions of each case's errors: runs of them with no longer gap than `gap`."""
    rows = _watermarked(events, late).where(severity_rank() >= 4)
    out = rows.groupBy("case_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return out.select("case_id", "w.start", "w.end", "count")


EPISODE = "case_id string, denial_event_id string, denial_ts timestamp, end_event_id string, kind string"
_STATE = "event_id string, ts timestamp, success boolean"


def denial_episodes(markers: DataFrame, idle: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Denial episodes of a stream of marker rows (case_id, event_id, ts, success, denial, normal), as they end.

    A denial opens an episode; a normal row ends it (recovered), a denial after a success ends it and opens the next (superseded), and where a case is silent
    for `idle` it ends as open. Rows of a case are taken in the order of time within each batch; the state of a case is one row.
    """
    wait = pd.Timedelta(idle).value // 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        if state.hasTimedOut:
            if held:
                out.append((key[0], held[0], held[1], None, "open"))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for r in rows.itertuples():
                if held and r.success:
                    held = (held[0], held[1], True)
                if r.denial:
                    if held and held[2]:
                        out.append((key[0], held[0], held[1], r.event_id, "superseded"))
                        held = None
                    held = held or (r.event_id, r.ts.to_pydatetime(), False)
                if r.normal and held:
                    out.append((key[0], held[0], held[1], r.event_id, "recovered"))
                    held = None
            if held:
                state.update(held)
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), rows["ts"].max().value // 1_000_000) + wait)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["case_id", "denial_event_id", "denial_ts", "end_event_id", "kind"]).astype({"denial_ts": "datetime64[us]"})

    rows = markers.withWatermark("ts", late).select("case_id", "event_id", "ts", "success", "denial", "normal")
    return rows.groupBy("case_id").applyInPandasWithState(step, EPISODE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_sink(path: str):
    """A foreachBatch function that appends the events that are new to the Parquet table at path, the first of each id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
        existing = spark.read.schema(batch.schema).parquet(path) if there else spark.createDataFrame([], batch.schema)
        new_events(existing, batch).write.mode("append").parquet(path)

    return write
