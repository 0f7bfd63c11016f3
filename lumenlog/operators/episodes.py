"""Denial episodes: detection, lead-up window, attribution, flags and counter correlation.

Marker rows carry (case_id, i, event_id, ts) and the flags success, denial and normal; i orders the rows of a case densely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detect(markers: DataFrame) -> DataFrame:
    """Episodes of each case: a denial opens one; it lasts to a normal row, to a denial after a success, or to the end.

    The state machine is window functions over the markers of a case: segments end at normal rows, and within a
    segment a denial opens an episode if it is the first or if a success lies between it and the denial before.
    """
    case = Window.partitionBy("case_id").orderBy("i")
    upto = case.rowsBetween(Window.unboundedPreceding, 0)
    before = case.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("case_id")
    rows = markers.select(
        "case_id", "i", "event_id", "ts", "denial",
        F.coalesce(F.sum(F.col("normal").cast("int")).over(before), F.lit(0)).alias("seg"),
        F.sum(F.col("success").cast("int")).over(upto).alias("successes"),
        F.when(F.col("normal"), F.col("i")).alias("normal_at"), F.when(F.col("normal"), F.col("event_id")).alias("normal_id"),
        F.min("i").over(whole).alias("first_i"), F.max("i").over(whole).alias("last_i"),
    )
    segment = Window.partitionBy("case_id", "seg")
    rows = rows.withColumn("normal_at", F.max("normal_at").over(segment)).withColumn("normal_id", F.max("normal_id").over(segment)).where("denial")
    within = Window.partitionBy("case_id", "seg").orderBy("i")
    prior = F.lag("successes").over(within)
    opening = rows.withColumn("prior", prior).where("prior is null or successes > prior")
    following = F.lead("i").over(within)
    ends = opening.withColumn("next_i", following).withColumn("span_end", F.coalesce(F.col("next_i") - 1, "normal_at", "last_i"))
    return ends.select(
        "case_id", F.col("event_id").alias("denial_event_id"), F.col("ts").alias("denial_ts"), F.col("i").alias("denial_i"),
        F.when(F.col("next_i").isNull(), F.col("normal_id")).alias("recovery_event_id"),
        (F.col("next_i").isNull() & F.col("normal_at").isNull()).alias("open_truncated"),
        F.coalesce(F.lag("span_end").over(Window.partitionBy("case_id").orderBy("i")) + 1, "first_i").alias("span_start"), "span_end",
    )


def inside(rows: DataFrame, episodes: DataFrame, columns: list[str]) -> DataFrame:
    """rows (case_id, i, ...) before the denial of the episode whose span they lie in, with the episode's columns.

    Spans are disjoint, so one ordered pass over each case gives every row its episode; there is no range join.
    """
    starts = episodes.select("case_id", F.col("span_start").alias("i"), F.struct("denial_i", *columns).alias("_episode"))
    both = rows.withColumn("_episode", F.lit(None).cast(starts.schema["_episode"].dataType)).withColumn("_row", F.lit(1)).unionByName(starts.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("case_id").orderBy("i", "_row").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_episode", F.last("_episode", ignorenulls=True).over(order)).where("_row = 1 and _episode is not null and i < _episode.denial_i")
    return filled.select(*rows.columns, *(F.col(f"_episode.{c}").alias(c) for c in columns))


def descent_window(episodes: DataFrame, samples: DataFrame, percent: int = 25) -> DataFrame:
    """Where the lead-up of each episode starts: after the last sample at or above percent of the final high-water mark.

    samples: (case_id, i, event_id, available, hwm) rows; those in [span_start, denial) belong to an episode.
    """
    by = ["case_id", "denial_event_id"]
    rows = inside(samples, episodes, ["denial_event_id"])
    mark = rows.groupBy(*by).agg(F.max_by("hwm", "i").alias("mark"))
    graded = rows.join(mark, by).withColumn("above", F.col("available") >= F.col("mark") * percent / 100)
    last = graded.groupBy(*by).agg(F.max(F.when(F.col("above"), F.col("i"))).alias("last_above"))
    after = F.when(F.col("last_above").isNull() | (F.col("i") > F.col("last_above")), F.col("i"))
    figures = graded.join(last, by).groupBy(*by).agg(F.min_by("event_id", after).alias("start"), F.max_by("event_id", "i").alias("last"), F.count(F.lit(1)).alias("request_count"))
    out = episodes.select(*by).join(figures, by, "left")
    return out.select(*by, F.lit(percent).alias("threshold_pct"), F.coalesce("start", "last").alias("start_event_id"), F.coalesce("request_count", F.lit(0)).cast("long").alias("request_count"))


def attribution(episodes: DataFrame, grants: DataFrame) -> DataFrame:
    """Granted bytes and requests before each denial, by object, by source and by session: one pass with grouping sets.

    grants: (case_id, i, event_id, oid, source_key, sid, bytes).
    """
    rows = inside(grants, episodes, ["denial_event_id"])
    sets = rows.select("case_id", "denial_event_id", "bytes", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key")) for d, c in (("oid", "oid"), ("source", "source_key"), ("sid", "sid"))])).alias("d"))
    return sets.groupBy("case_id", "denial_event_id", "d.dimension", "d.key").agg(F.sum("bytes").alias("granted_bytes"), F.count(F.lit(1)).alias("request_count"))


def top_attribution(rows: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("case_id", "denial_event_id", "dimension").orderBy(F.desc("granted_bytes"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grade(value: Column, warn: float, critical: float, lower_is_worse: bool = False) -> Column:
    if lower_is_worse:
        return F.when(value <= critical, "critical").when(value <= warn, "warn").otherwise("info")
    return F.when(value >= critical, "critical").when(value >= warn, "warn").otherwise("info")


def counter_trends(samples: DataFrame, by: list[str]) -> DataFrame:
    """Last value, first value, slope a second and peak (earliest on ties) of each counter series.

    samples: by columns, counter, ts, event_id, value; null values are excluded and counted.
    """
    present = F.col("value").isNotNull()
    at = F.struct("ts", "event_id")
    ts = F.when(present, F.col("ts").cast("timestamp"))
    seconds = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1e6)
    out = samples.groupBy(*by, "counter").agg(
        F.max_by("value", F.when(present, at)).alias("last_value"), F.max_by("event_id", F.when(present, at)).alias("last_event_id"), F.min_by("value", F.when(present, at)).alias("first_value"),
        F.max("value").alias("peak"), F.min_by("event_id", F.when(present, F.struct((-F.col("value")).alias("v"), "ts", "event_id"))).alias("peak_event_id"),
        F.count("value").alias("sample_count"), F.count_if(~present).alias("excluded_samples"), seconds.alias("seconds"),
    )
    return out.withColumn("slope_per_second", F.when(F.col("seconds") > 0, (F.col("last_value") - F.col("first_value")) / F.col("seconds"))).drop("seconds")


def correlate(spans: DataFrame, samples: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Samples inside each span (closed bounds) of the same case; spans without samples stay as one row with nulls.

    Time buckets turn the range join into an equi join, so it stays local at any size; a span visits the buckets it touches.
    spans: case_id, span_id, start_ts, end_ts. samples: case_id, ts and more.
    """
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_seconds)
    left = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("end_ts")))))
    found = left.join(samples.withColumn("_b", bucket(F.col("ts"))), ["case_id", "_b"]).where("ts between start_ts and end_ts").drop("_b", "start_ts", "end_ts")
    return spans.join(found, ["case_id", "span_id"], "left")
