"""Template groups and their salience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask, short_hash
from ..schema import canonical_key, severity_name, severity_rank
from .events import ranking_events

EXEMPLARS = 5


def template_groups(events: DataFrame, masked: Column | None = None) -> DataFrame:
    """Events grouped by case and masked message: count, first and last time, highest severity, first exemplar ids.

    Counts are a partial aggregate. For the exemplars each task keeps its first few rows of a group before the shuffle (a
    row-number limit that Spark pushes below the exchange), so a group of any size moves a few rows from each task.
    """
    rows = ranking_events(events).withColumn("template", mask("message") if masked is None else masked)
    by = ["case_id", "template"]
    figures = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(severity_rank()).alias("rank"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("k"))
    few = rows.select(*by, canonical_key().alias("k")).withColumn("n", first).where(F.col("n") <= EXEMPLARS)
    exemplars = few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["id"]).alias("exemplar_event_ids"))
    joined = figures.join(exemplars, by)
    return joined.select("case_id", short_hash("template").alias("template_id"), "template", "count", "first_ts", "last_ts", severity_name(F.col("rank")).alias("severity_max"), "exemplar_event_ids")


def seconds(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def salience(clusters: DataFrame, incident: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Clusters (case_id, cluster_id, count, severity_max, first_ts, last_ts) with score and rank within the case.

    Fixed weights: severity .35, count .20, burst .15, novelty .10, proximity .20. Bounds drop clusters before any figure of the case.
    """
    if since or until:
        clusters = clusters.where((F.col("last_ts") >= F.lit(since).cast("timestamp")) if since else F.col("last_ts").isNotNull())
        if until:
            clusters = clusters.where(F.col("first_ts") <= F.lit(until).cast("timestamp"))
    first, last = seconds(F.col("first_ts")), seconds(F.col("last_ts"))
    raw = F.col("count") / F.greatest(last - first, F.lit(1.0))
    case = clusters.groupBy("case_id").agg(F.max("count").alias("_top"), F.min(raw).alias("_low"), F.max(raw).alias("_high"), F.max(last).alias("_end"), (F.max(last) - F.min(first)).alias("_span"))
    rows = clusters.join(case, "case_id")
    at = seconds(F.lit(incident).cast("timestamp")) if incident else F.col("_end")
    tau = F.when(F.col("_span") > 0, F.col("_span") / 4).otherwise(3600.0)
    burst = F.when(F.col("_high") > F.col("_low"), (raw - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    score = (
        0.35 * severity_rank("severity_max") / 5
        + 0.20 * F.log1p("count") / F.log1p(F.greatest(F.col("_top"), F.lit(1)))
        + 0.15 * F.coalesce(burst, F.lit(0.0))
        + 0.10 * F.coalesce(F.exp(-F.abs(first - at) / tau), F.lit(0.0))
        + 0.20 * F.coalesce(F.exp(-F.abs(last - at) / tau), F.lit(0.0))
    )
    scored = rows.withColumn("score", score).drop("_top", "_low", "_high", "_end", "_span")
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "cluster_id")
    return scored.withColumn("rank", F.row_number().over(order))
