"""The canonical event relation and its severity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = (
    "event_id string, case_id string, ts timestamp, ts_confidence string, source string, source_file string, line_start int, line_end int, "
    "severity string, component string, thread string, session string, message string, attrs map<string,string>, raw string"
)
#: Severities by rank.
SEVERITIES = ("unknown", "debug", "info", "warn", "error", "fatal")
#: Sources whose rows never take part in ranking.
UNRANKED = ("dssperfmon", "eustack")


def severity_rank(column: str | Column = "severity") -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), c) - 1, F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def canonical_order() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("source_file"), F.col("line_start"), F.col("event_id")]


def canonical_key() -> Column:
    """A struct that sorts like canonical_order(), null times last."""
    return F.struct(F.col("ts").isNull().alias("late"), F.col("ts").alias("ts"), F.col("source_file").alias("f"), F.col("line_start").alias("l"), F.col("event_id").alias("id"))
