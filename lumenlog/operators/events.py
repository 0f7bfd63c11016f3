"""Row-level queries over the event relation: filters, order, paging, and idempotent writes."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNRANKED, canonical_key, canonical_order

EVENT_FILTERS = {
    "severity": lambda v: F.col("severity") == v,
    "source": lambda v: F.col("source") == v,
    "file": lambda v: F.col("source_file").contains(v),
    "since": lambda v: F.col("ts") >= F.lit(v).cast("timestamp"),
    "until": lambda v: F.col("ts") <= F.lit(v).cast("timestamp"),
}
GROUP_FILTERS = {"severity": lambda v: F.col("severity_max") == v, "min-count": lambda v: F.col("count") >= int(v), "contains": lambda v: F.col("template").contains(v)}
CLUSTER_FILTERS = GROUP_FILTERS | {"contains": lambda v: F.col("signature").contains(v)}
VERDICT_FILTERS = {"target-type": lambda v: F.col("target_type") == v, "target-id": lambda v: F.col("target_id") == v, "verdict": lambda v: F.col("verdict") == v}


def parse_moment(text: str) -> datetime:
    """An ISO time as UTC; without an offset it is UTC. Anything else is an error."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"not an ISO time: {text!r}") from e
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def parse_filters(specs: list[str], allowed: dict) -> dict[str, str]:
    """key=value specs, split at the first =; unknown and repeated keys are errors."""
    out: dict[str, str] = {}
    for spec in specs:
        key, found, value = spec.partition("=")
        if not found or key not in {*allowed, "limit"}:
            raise ValueError(f"unknown filter: {spec}")
        if key in out:
            raise ValueError(f"repeated filter: {key}")
        if key in ("limit", "min-count") and (not value.isdigit()):
            raise ValueError(f"not a count: {spec}")
        if key in ("since", "until"):
            parse_moment(value)
        out[key] = value
    return out


def apply_filters(df: DataFrame, filters: dict[str, str], allowed: dict, order: list[Column] | None = None) -> DataFrame:
    """The conjunction of allowlisted filters, then the order and the limit."""
    unknown = set(filters) - set(allowed) - {"limit"}
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    for key, value in filters.items():
        if key != "limit":
            df = df.where(allowed[key](value))
    if order:
        df = df.orderBy(*order)
    return df.limit(int(filters["limit"])) if "limit" in filters else df


def query_events(events: DataFrame, filters: dict[str, str]) -> DataFrame:
    return apply_filters(events, filters, EVENT_FILTERS, canonical_order())


def ranking_events(events: DataFrame) -> DataFrame:
    """Events that may be ranked; the others stay available as evidence."""
    return events.where(~F.col("source").isin(*UNRANKED))


def page_after(events: DataFrame, key: dict | None, size: int = 200) -> DataFrame:
    """The next page in canonical order after the row with the given key: a bounded top-k, no offset scan. Null times come last."""
    if key is not None:
        rest = F.struct("source_file", "line_start", "event_id") > F.struct(F.lit(key["source_file"]), F.lit(key["line_start"]), F.lit(key["event_id"]))
        if key["ts"] is None:
            events = events.where(F.col("ts").isNull() & rest)
        else:
            at = F.lit(key["ts"])
            events = events.where(F.col("ts").isNull() | (F.col("ts") > at) | ((F.col("ts") == at) & rest))
    return events.orderBy(*canonical_order()).limit(size)


def new_events(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving rows to append: the first of each id in canonical order, none that exists."""
    keys = ["case_id", "event_id"]
    return first_rows(arriving, keys, canonical_key()).join(existing.select(*keys), keys, "left_anti")


def first_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that is first in order, by a partial aggregate; maps and other types without an order are carried along."""
    best = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), order).alias("_best"))
    return best.select("_best.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """new, one row of each key (the first in order, by default by all its columns), and the existing rows with other keys."""
    own = first_rows(new, keys, F.struct(*[F.to_json(F.struct(c)) for c in new.columns if c not in keys]) if order is None else order)
    return existing.join(own.select(*keys), keys, "left_anti").unionByName(own)


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key of an append-only log, by a partial aggregate."""
    packed = F.max(F.struct(*[c.alias(f"_o{n}") for n, c in enumerate(order)], F.struct(*[F.col(c) for c in log.columns]).alias("_row"))).alias("_best")
    return log.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(packed).select("_best._row.*")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
