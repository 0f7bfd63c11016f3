"""Performance counters: samples around denials, per-file ranges, trends and hazards.

Where a case has denials its samples are matched with each denial's lead-up window; else each file's whole range is taken.
Samples meet spans in an equi-join over time buckets (see `episodes.correlate`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite_number, iso_utc
from .episodes import correlate, counter_trends

SOURCE = "dssperfmon"
#: Keys of a sample that are no counters, the counter that contradicts a denial, ids cited by a hazard at most, decimals.
PROVENANCE = ("byte_offset", "byte_len", "host", "pdh_version", "tz_name", "tz_offset_min", "unparsed_columns", "counter_set_drift")
DENIAL_COUNTER = "Total MCM Denial"
CITED = 10
VALUE_PLACES, SLOPE_PLACES = 3, 4
#: Labels of groups that no window was resolved for.
FULL_RANGE = "Full sample range (no MCM denial episode detected, so no correlation window was resolved)"
NO_PLACEABLE = "No perfmon sample in this file carried a placeable timestamp, so no sample range could be resolved and no trend was computed (samples disclosed as a hazard, not dropped)"
UNATTRIBUTED = "Perfmon samples carried no placeable timestamp, so they fall in no denial window and no sample range; they are disclosed here rather than dropped silently (a case-wide disclosure, not a correlation window)"
UNATTRIBUTED_KEY = "<unattributed>"
#: Fixed order of hazards within a group.
DIMENSIONS = ("span", "non_overlap", "denial_always_zero", "counter_set_drift", "unplaceable_samples")

HAZARD = "case_id string, scope string, key string, dimension string, severity string, message string, event_ids array<string>, value double"


def samples(events: DataFrame) -> DataFrame:
    return events.where(F.col("source") == SOURCE)


def denial_keys(attrs: Column) -> Column:
    """The keys of a sample that hold the denial counter: its bare name, or else every qualified one, sorted."""
    plain = F.map_contains_key(attrs, F.lit(DENIAL_COUNTER))
    qualified = F.filter(F.map_keys(attrs), lambda k: F.element_at(F.split(k, r"\\"), -1) == DENIAL_COUNTER)
    return F.when(plain, F.array(F.lit(DENIAL_COUNTER))).otherwise(F.array_sort(qualified))


def cited(ids: Column) -> tuple[Column, Column]:
    """The first distinct ids, up to the cap, and how many there are."""
    distinct = F.array_distinct(ids)
    return F.slice(distinct, 1, CITED), F.size(distinct)


def resolve_spans(windows: DataFrame, episodes: DataFrame, events: DataFrame, span_events: DataFrame) -> DataFrame:
    """Both ends of each denial's window as events: start and end id and time, or the reason why there is none.

    The end is the denial's event. The start is the window's first event, or, for the whole lead-up, the first of the
    episode's events that has a time.
    """
    known = events.select("case_id", F.col("event_id").alias("known_id"), F.col("ts").alias("known_ts"), F.lit(True).alias("known"))
    by = ["case_id", "denial_event_id"]
    base = episodes.select(*by).join(windows.select(*by, "start_event_id", "label"), by, "left")

    def with_end(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        named = known.select("case_id", F.col("known_id").alias(id_col), F.col("known_ts").alias(f"{name}_ts"), F.col("known").alias(f"{name}_known"))
        return rows.join(named, ["case_id", id_col], "left")

    rows = with_end(with_end(base, "denial_event_id", "end"), "start_event_id", "window")
    first = span_events.where("ts is not null").groupBy(*by).agg(F.min_by(F.struct("event_id", "ts"), "position").alias("first"))
    rows = rows.join(first, by, "left")
    whole = F.col("start_event_id").isNull()
    reason = (
        F.when(F.col("end_known").isNull(), "the denial event is absent from the case store")
        .when(F.col("end_ts").isNull(), "the denial event carries no timestamp")
        .when(~whole & F.col("window_known").isNull(), "the window start event is absent from the store")
        .when(~whole & F.col("window_ts").isNull(), "the window start event carries no timestamp")
        .when(whole & F.col("first").isNull(), "no episode event carries a timestamp to start from")
    )
    attempted = F.array_distinct(F.array_compact(F.array("start_event_id", "denial_event_id")))
    rows = rows.withColumn("reason", reason)
    resolved = F.col("reason").isNull()
    return rows.select(
        "case_id", F.col("denial_event_id").alias("span_id"), "label", "reason", attempted.alias("attempted"),
        F.when(resolved, F.when(whole, F.col("first.event_id")).otherwise(F.col("start_event_id"))).alias("start_event_id"), F.when(resolved, F.when(whole, F.col("first.ts")).otherwise(F.col("window_ts"))).alias("start_ts"),
        F.when(resolved, F.col("end_ts")).alias("end_ts"),
    )


def trends(placed: DataFrame, by: list[str]) -> DataFrame:
    """Trends of every counter in rows (by, event_id, ts, attrs); each key but provenance is a counter."""
    long = placed.select(*by, "event_id", "ts", F.explode(F.map_filter("attrs", lambda k, _: ~k.isin(*PROVENANCE))).alias("counter", "text")).withColumn("value", finite_number(F.col("text")))
    out = counter_trends(long, by)
    return out.select(*by, "counter", F.round("last_value", VALUE_PLACES).alias("at_denial"), F.col("last_event_id").alias("at_denial_event_id"), F.round("slope_per_second", SLOPE_PLACES).alias("slope_per_second"), F.round("peak", VALUE_PLACES).alias("peak"), "peak_event_id", (F.col("sample_count") + F.col("excluded_samples")).alias("sample_count"), "excluded_samples")


def _hazard(rows: DataFrame, scope: Column, key: str, dimension: str, severity: str, message: Column, ids: Column, value: Column) -> DataFrame:
    return rows.select("case_id", scope.alias("scope"), F.col(key).alias("key"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), message.alias("message"), ids.alias("event_ids"), value.cast("double").alias("value"))


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _ids_in_order(when: Column | None = None) -> Column:
    row = F.struct("ts", "event_id")
    return F.transform(F.array_sort(F.collect_list(row if when is None else F.when(when, row))), lambda x: x["event_id"])


def hazard_span(spans: DataFrame) -> DataFrame:
    rows = spans.where("reason is not null")
    return _hazard(rows, F.lit("episode"), "span_id", "span", "warn", _joined("No perfmon trend could be correlated: ", F.col("reason"), "."), F.col("attempted"), F.lit(None))


def hazard_non_overlap(spans: DataFrame, placed: DataFrame, all_samples: DataFrame) -> DataFrame:
    """Resolved spans without samples; cites the span's ends and the case's first and last sample."""
    empty = spans.where("reason is null").join(placed.select("case_id", "span_id").distinct(), ["case_id", "span_id"], "left_anti")
    at = F.struct("ts", "event_id")
    reach = all_samples.where("ts is not null").groupBy("case_id").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    rows = empty.join(reach, "case_id", "left")
    covers = F.when(F.col("first").isNull(), "the case carries no perfmon samples at all").otherwise(_joined("the case's perfmon samples cover ", iso_utc(F.col("first.ts")), " to ", iso_utc(F.col("last.ts"))))
    message = _joined(
        "No perfmon samples fall inside the correlated span ", iso_utc(F.col("start_ts")), " to ", iso_utc(F.col("end_ts")), "; ", covers,
        ". The two artefacts do not overlap in time, so no trend is reported rather than one computed from unrelated samples. This hazard covers time non-overlap only, not host identity: a sample from the wrong host whose clock overlaps will not trip it (multi-host correlation is deferred to PERFV2-02).",
    )
    ids = F.array_distinct(F.array_compact(F.array("start_event_id", "span_id", "first.event_id", "last.event_id")))
    return _hazard(rows, F.lit("episode"), "span_id", "non_overlap", "critical", message, ids, F.lit(None))


def hazard_denial_always_zero(placed: DataFrame) -> DataFrame:
    """Spans in which the denial counter was read and is zero throughout, against the denial that opened them."""
    read = placed.withColumn("value", F.explode(F.transform(denial_keys(F.col("attrs")), lambda k: finite_number(F.col("attrs")[k])))).where("value is not null")
    rows = read.groupBy("case_id", "span_id").agg(F.bool_and(F.col("value") == 0).alias("zero"), F.count(F.lit(1)).alias("readings"), _ids_in_order().alias("ids")).where("zero")
    shown, total = cited(F.concat(F.array("span_id"), F.col("ids")))
    message = _joined(f"{DENIAL_COUNTER} read 0 on all ", F.col("readings"), " in-span reading(s) despite a detected MCM denial in this window, so the counter is almost certainly not wired on this host and must not be read as evidence that no denial occurred. Citing ", F.size(shown), " of ", total, " evidencing event(s).")
    return _hazard(rows, F.lit("episode"), "span_id", "denial_always_zero", "warn", message, shown, F.lit(0.0))


def hazard_counter_set_drift(placed: DataFrame, key: str = "span_id", scope: str = "episode") -> DataFrame:
    """Groups with samples whose counters differ from the file's header, as the parser marked them."""
    drifted = F.map_contains_key(F.col("attrs"), F.lit("counter_set_drift"))
    rows = placed.where(drifted).groupBy("case_id", key).agg(_ids_in_order().alias("ids"))
    shown, total = cited(F.col("ids"))
    message = _joined(total, " in-span sample(s) carry a counter set that drifted from the file's header, so their counters are aligned by position against a header that no longer describes them and the trend figures over this span may be incomplete. Citing ", F.size(shown), " of ", total, " drifted event(s).")
    return _hazard(rows, F.lit(scope), key, "counter_set_drift", "warn", message, shown, total)


def hazard_unplaceable(all_samples: DataFrame, key: Column) -> DataFrame:
    """Samples without a time, by file or (a literal key) for the case."""
    rows = all_samples.where("ts is null").groupBy("case_id", key.alias("key")).agg(F.sort_array(F.collect_set("event_id")).alias("ids"))
    shown, total = cited(F.col("ids"))
    message = _joined(total, " perfmon sample(s) for this file carry no placeable timestamp, so they fall outside the sample range and every trend figure computed over it; they are disclosed here rather than dropped silently. Citing ", F.size(shown), " of ", total, " sample(s).")
    return _hazard(rows, F.lit("file"), "key", "unplaceable_samples", "info", message, shown, total)


def _group(rows: DataFrame, scope: str, key: str, label: Column, start: Column, end: Column, ids: Column, count: Column) -> DataFrame:
    return rows.select("case_id", F.lit(scope).alias("scope"), F.col(key).alias("key"), label.alias("label"), start.cast("timestamp").alias("start_ts"), end.cast("timestamp").alias("end_ts"), ids.cast("array<string>").alias("boundary_event_ids"), count.cast("long").alias("sample_count"))


def analyse(events: DataFrame, denials: dict[str, DataFrame], span_events: DataFrame, bucket_seconds: int = 3600, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> dict[str, DataFrame]:
    """Frames groups, counters and hazards of all cases; denials: the frames of denials.analyse.

    A case with denials has a group for each, and one for samples without a time; a case without has a group for each file. keep is
    applied to what several frames share.
    """
    all_samples = samples(events)
    spans = keep(resolve_spans(denials["windows"], denials["episodes"], events, span_events))
    resolved = spans.where("reason is null")
    timed = all_samples.where("ts is not null").select("case_id", "event_id", "ts", "attrs")
    placed = keep(correlate(resolved.select("case_id", "span_id", "start_ts", "end_ts"), timed, bucket_seconds).where("event_id is not null").select("case_id", "span_id", "event_id", "ts", "attrs"))
    counts = placed.groupBy("case_id", "span_id").agg(F.count(F.lit(1)).alias("n"))
    own = spans.join(counts, ["case_id", "span_id"], "left")
    ids = F.when(F.col("reason").isNull(), F.array("start_event_id", "span_id")).otherwise(F.col("attempted"))
    groups = _group(own, "episode", "span_id", F.col("label"), F.col("start_ts"), F.col("end_ts"), ids, F.coalesce("n", F.lit(0)))
    with_denials = denials["episodes"].select("case_id").distinct()
    none = F.lit(None)
    loose = all_samples.where("ts is null").join(with_denials, "case_id", "left_semi")
    cases = loose.select("case_id").distinct().withColumn("key", F.lit(UNATTRIBUTED_KEY))
    groups = groups.unionByName(_group(cases, "file", "key", F.lit(UNATTRIBUTED), none, none, F.array(), F.lit(0)))
    files = all_samples.join(with_denials, "case_id", "left_anti")
    at = F.struct("ts", "event_id")
    timed_at = F.when(F.col("ts").isNotNull(), at)
    ranges = files.groupBy("case_id", "source_file").agg(F.min(timed_at).alias("first"), F.max(timed_at).alias("last"), F.count("ts").alias("n"))
    label = F.when(F.col("n") > 0, FULL_RANGE).otherwise(NO_PLACEABLE)
    ends = F.when(F.col("n") > 0, F.array("first.event_id", "last.event_id")).otherwise(F.array().cast("array<string>"))
    groups = groups.unionByName(_group(ranges, "file", "source_file", label, F.col("first.ts"), F.col("last.ts"), ends, F.col("n")))
    filed = files.where("ts is not null").select("case_id", "source_file", "event_id", "ts", "attrs")
    counters = trends(placed, ["case_id", "span_id"]).withColumnRenamed("span_id", "key").withColumn("scope", F.lit("episode"))
    counters = counters.unionByName(trends(filed, ["case_id", "source_file"]).withColumnRenamed("source_file", "key").withColumn("scope", F.lit("file")))
    hazards = hazard_span(spans)
    parts = [hazard_non_overlap(spans, placed, all_samples), hazard_denial_always_zero(placed), hazard_counter_set_drift(placed), hazard_unplaceable(loose, F.lit(UNATTRIBUTED_KEY)), hazard_counter_set_drift(filed, "source_file", "file"), hazard_unplaceable(files, F.col("source_file"))]
    for part in parts:
        hazards = hazards.unionByName(part)
    return {"groups": groups, "counters": counters, "hazards": hazards}


def file_order(events: DataFrame) -> DataFrame:
    """(case_id, source_file, position): files by their first sample in canonical order."""
    from ..schema import canonical_key

    first = samples(events).groupBy("case_id", "source_file").agg(F.min(canonical_key()).alias("first"))
    return first.select("case_id", "source_file", (F.row_number().over(Window.partitionBy("case_id").orderBy("first")) - 1).alias("position"))
