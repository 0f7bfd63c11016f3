"""CSV artefacts as DataFrames of safe cells, one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import csv_safe, mebibytes
from ..operators.stacks import report_order


def _joined(ids: str) -> Column:
    return F.array_join(ids, ";")


def attribution_rows(denials: dict[str, DataFrame]) -> DataFrame:
    """episode_id, dimension, key, granted_bytes, granted_mb, request_count, event_ids; by denial, dimension, bytes and key."""
    rows = denials["attribution"].join(denials["episodes"].select("case_id", "denial_event_id", "denial_place"), ["case_id", "denial_event_id"])
    place = F.array_position(F.array(F.lit("oid"), F.lit("source"), F.lit("sid")), F.col("dimension"))
    return rows.orderBy("denial_place", place, F.desc("granted_bytes"), "key").select(F.col("denial_event_id").alias("episode_id"), "dimension", csv_safe(F.col("key")).alias("key"), "granted_bytes", mebibytes(F.col("granted_bytes")).alias("granted_mb"), "request_count", _joined("event_ids").alias("event_ids"))


def trend_rows(counters: dict[str, DataFrame]) -> DataFrame:
    """A row for each counter of each span; a span without counters has one row without figures."""
    by = ["case_id", "scope", "key"]
    own = counters["counters"].withColumnRenamed("sample_count", "_samples")
    rows = counters["groups"].join(own, by, "left").orderBy(F.col("scope"), F.col("start_ts").asc_nulls_last(), "key", "counter")
    text = lambda c: csv_safe(F.col(c))
    return rows.select(
        text("scope").alias("group_scope"), text("key").alias("group_key"), text("label").alias("group_label"), text("counter").alias("counter"), "at_denial", text("at_denial_event_id").alias("at_denial_event_id"), "slope_per_second", "peak",
        text("peak_event_id").alias("peak_event_id"), F.coalesce("_samples", "sample_count").alias("sample_count"), "excluded_samples", csv_safe(_joined("boundary_event_ids")).alias("boundary_event_ids"),
    )


def signature_rows(stacks: dict[str, DataFrame]) -> DataFrame:
    """A row for each signature with a column for each dump, in dump order, and the deltas; of one case."""
    dumps = [r.dump for r in stacks["dumps"].orderBy("dump_idx").select("dump").collect()]  # one column each
    rows = stacks["progression"].orderBy(*report_order("progression"))
    text = lambda c: csv_safe(F.col(c))
    per_dump = [F.get("counts", F.lit(n)).alias(_header(name)) for n, name in enumerate(dumps)]
    steps = csv_safe(F.array_join(F.transform("step_deltas", lambda x: x.cast("string")), ";"))
    return rows.select(
        text("role").alias("role"), text("subsystem").alias("subsystem"), text("pattern").alias("matched_pattern"), "frame_index", text("reason").alias("reason"), text("matched_frame").alias("matched_frame"), text("leaf_frame").alias("leaf_frame"),
        F.coalesce(F.element_at("counts", -1), F.lit(0).cast("long")).alias("thread_count"), *per_dump, steps.alias("step_deltas"), "overall_delta",
    )


def _header(name: str) -> str:
    return f"'{name}" if name.lstrip()[:1] in ("=", "+", "-", "@") else name


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, in a folder of that path; rows keep their order, and nulls are empty cells."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def pivoted(signature_counts: DataFrame, dumps: list[str]) -> DataFrame:
    """Thread counts with a column for each of the named dumps, zero where a signature is absent; dumps fix the order."""
    wide = signature_counts.groupBy("case_id", "frames").pivot("dump", dumps).agg(F.sum("thread_count"))
    return wide.na.fill(0, dumps)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    return rows.withColumn("row", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))
