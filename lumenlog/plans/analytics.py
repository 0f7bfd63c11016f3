"""Queries of the composite analyses over generated artefacts, and their SQL.

A user of the `events` table is a case. Its rows are written as the artefacts that the operators read: purchases as grant lines of a server
log, errors as denial banners with a memory block, signups as normal lines, clicks as memory dumps or lifecycle lines, views as counter
samples. The SQL says what must come out from the table's columns alone, without the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters, counters, denials, evaluation, events as ev, facts, stacks, templates, triage
from ..render import tables
from ..store import review_progress as progress
from .catalogue import EVENTS, GROUPS, RULES, SIGNATURES, canonical, query, table, threads

#: The case, file, number and order of each row, in SQL.
BASE = """b AS (SELECT *, CAST(user_id AS VARCHAR) AS case_id, CAST(event_id AS VARCHAR) AS id, 'node' || CAST(event_id % 2 AS VARCHAR) || '/DSSErrors.log' AS file,
  CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS size, CAST(floor(value * 1000) AS BIGINT) AS available, CAST(floor(value * 3000) AS BIGINT) AS hwm FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, file, event_id) AS i, lead(file) OVER (PARTITION BY case_id ORDER BY ts, file, event_id) AS next_file FROM b WHERE event_type <> 'view')"""
DENIALS = f"""{BASE},
a AS (SELECT *, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
  sum((event_type = 'purchase')::INT) OVER (PARTITION BY case_id ORDER BY i) AS cs, coalesce(sum((event_type IN ('error', 'signup'))::INT) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM l),
s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN i END) OVER (PARTITION BY case_id, seg) AS seg_end, max(CASE WHEN event_type = 'signup' THEN id END) OVER (PARTITION BY case_id, seg) AS seg_id FROM a),
d AS (SELECT *, lag(cs) OVER (PARTITION BY case_id, seg ORDER BY i) AS p FROM s WHERE event_type = 'error'),
o AS (SELECT *, lead(i) OVER (PARTITION BY case_id, seg ORDER BY i) AS nx FROM d WHERE p IS NULL OR cs > p),
ep AS (SELECT *, coalesce(lag(coalesce(nx - 1, seg_end)) OVER (PARTITION BY case_id ORDER BY i) + 1, 1) AS span_start, coalesce(nx - 1, seg_end, 1000000000) AS span_end FROM o),
grants AS (SELECT e.case_id, e.id AS denial, g.i, g.id, g.size, g.available, g.hwm, md5('o' || CAST(g.event_id % 7 AS VARCHAR)) AS oid, md5('s' || CAST(g.event_id % 5 AS VARCHAR)) AS sid, 'S' || CAST(g.event_id % 3 AS VARCHAR) AS source_key, g.event_id % 11 <> 0 AS matched
  FROM ep e JOIN l g ON g.case_id = e.case_id AND g.i >= e.span_start AND g.i < e.i AND g.event_type = 'purchase'),
gm AS (SELECT *, last_value(hwm) OVER (PARTITION BY case_id, denial ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mark, count(*) OVER (PARTITION BY case_id, denial) AS n FROM grants),
la AS (SELECT *, max(CASE WHEN available * 100 >= mark * 25 THEN i END) OVER (PARTITION BY case_id, denial) AS above FROM gm),
w AS (SELECT case_id, denial, any_value(mark) AS mark, any_value(n) AS n, arg_min(id, i) FILTER (WHERE above IS NULL OR i > above) AS start_id, min(i) FILTER (WHERE above IS NULL OR i > above) AS start_i, count(*) FILTER (WHERE above IS NULL OR i > above) AS below, arg_max(id, i) AS last_id, max(i) AS last_i FROM la GROUP BY 1, 2),
win AS (SELECT e.case_id, e.id AS denial, CASE WHEN mark > 0 THEN coalesce(start_id, last_id) END AS start_id, CASE WHEN mark > 0 THEN coalesce(start_i, last_i) ELSE e.span_start END AS start_i, mark,
  CASE WHEN mark > 0 THEN greatest(below, 1) ELSE coalesce(n, 0) END AS requests, CASE WHEN mark > 0 THEN 25 ELSE 0 END AS pct FROM ep e LEFT JOIN w ON w.case_id = e.case_id AND w.denial = e.id)"""


def _hex(prefix: str, number: Column) -> Column:
    return F.md5(F.concat(F.lit(prefix), number.cast("string")))


def artefacts(spark, sf_dir: str) -> DataFrame:
    """The rows of `events` as server-log and counter events."""
    n, k, value = F.col("event_id"), F.regexp_extract("props", r"(\d+)", 1).cast("long"), F.col("value")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    oid = F.when(n % 11 == 0, "").otherwise(said("[OID:", _hex("o", n % 7), "]"))
    grant = said(stamp, " [12][SID:", _hex("s", n % 5), "]", oid, " Contract Request Succeeded Size=", F.round(value * 100).cast("long"), " Source=S", n % 3, " AvailableMCM=", F.floor(value * 1000), " HWM(GB)=", F.floor(value * 3000), "\n")
    block = said("\tTotal System Physical Memory(MB): 1000\n\tTotal In Use Physical Memory For Other Processes(KB): ", k * 1024, "\n\tTotal In Use Virtual Memory For Intelligence Server(GB): 2\n\tCube Caches In Memory(MB): ", k * 10, "\n\tMMF Virtual Memory Size(MB): ", k, "\n\tWorking Set Cache RAM Usage(MB): ", k * 15, "\n\tUnused Memory Pool In SmartHeap(MB): ", k * 3, "\nNote: end\n\tCube Caches In Memory(MB): 1\n")
    denial = said(stamp, " IServer enters MCM denial state\n", F.when(n % 13 == 0, "").otherwise(block))
    dump = said("***** Start of Info Dump *****\nCurrent Memory Info:\nSystem Total = 1000 (1.0GB)\n\nSystem Available = ", k, " (", k, ".0 MB)\nMCM Settings:\nSmartHeap Cache Releasable = ", F.when(n % 3 == 0, "true").otherwise("false"), "\nMemory Reserve = 0 (0Bytes)\n***** End of Info Dump *****\n")
    life = said(stamp, " ", F.when(k % 3 == 0, "Memory status changes to low").when(k % 3 == 1, "Initiating emergency memory offload for Working Set").otherwise("Working set emergency offload completed; Memory status changes to low"), "\n")
    kind = F.col("event_type")
    raw = F.when(kind == "purchase", grant).when(kind == "error", denial).when(kind == "signup", said(stamp, " MCM State=normal\n")).when(n % 2 == 0, dump).otherwise(life)
    raw = F.regexp_replace(raw, r"\n$", "")
    sample = kind == "view"
    attrs = F.map_filter(F.create_map(F.lit("byte_offset"), n.cast("string"), F.lit(r"Object(A)\Total MCM Denial"), F.floor(value / 60).cast("string"), F.lit("Size(MB)"), F.when(n % 23 == 0, "NaN").otherwise(k.cast("string")), F.lit("counter_set_drift"), F.when(n % 19 == 0, "3 columns, expected 4")), lambda _, v: v.isNotNull())
    no_attrs = F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        n.cast("string").alias("event_id"), F.col("user_id").cast("string").alias("case_id"), F.when(~(sample & (n % 17 == 0)), F.col("ts")).cast("timestamp").alias("ts"), F.lit("exact").alias("ts_confidence"), F.when(sample, "dssperfmon").otherwise("dsserrors").alias("source"),
        F.when(sample, "perf.csv").otherwise(F.concat(F.lit("node"), (n % 2).cast("string"), F.lit("/DSSErrors.log"))).alias("source_file"), n.cast("int").alias("line_start"), n.cast("int").alias("line_end"), F.lit("info").alias("severity"),
        none.alias("component"), none.alias("thread"), none.alias("session"), F.trim(F.split_part(F.when(sample, "sample").otherwise(raw), F.lit("\n"), F.lit(1))).alias("message"), F.when(sample, attrs).otherwise(no_attrs).alias("attrs"), F.when(sample, "sample").otherwise(raw).alias("raw"),
    )


@query(f"WITH {DENIALS} SELECT case_id, id AS denial_event_id, ts AS denial_ts, CASE WHEN nx IS NULL THEN seg_id END AS recovery_event_id, nx IS NULL AND seg_end IS NULL AS open_truncated, event_id % 13 = 0 AND coalesce(next_file <> file, false) AS fragmented, (SELECT CAST(mark AS DECIMAL(38,0)) FROM w WHERE w.case_id = ep.case_id AND w.denial = ep.id) AS hwm_bytes FROM ep")
def denial_episodes(spark, sf_dir):
    return denials.analyse(artefacts(spark, sf_dir))["episodes"].select("case_id", "denial_event_id", F.col("denial_ts").cast("timestamp_ntz").alias("denial_ts"), "recovery_event_id", "open_truncated", "fragmented", "hwm_bytes")


@query(f"WITH {DENIALS} SELECT case_id, denial AS denial_event_id, pct AS threshold_pct, start_id AS start_event_id, requests AS request_count, CASE WHEN mark > 0 THEN 'AvailableMCM < 25% of HWM (0.0 GB)' ELSE 'full available lead-up' END AS label FROM win")
def denial_windows(spark, sf_dir):
    return denials.analyse(artefacts(spark, sf_dir))["windows"].select("case_id", "denial_event_id", "threshold_pct", "start_event_id", "request_count", "label")


@query(
    f"""WITH {DENIALS}, life AS (SELECT l.*, k % 3 AS m FROM l WHERE event_type = 'click' AND event_id % 2 = 1)
SELECT e.case_id, e.id AS denial_event_id, CAST(row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY x.i) - 1 AS INTEGER) AS position, CASE m WHEN 0 THEN 'memory-status-low' WHEN 1 THEN 'emergency-offload-start' ELSE 'emergency-offload-complete' END AS kind, x.id AS event_id
FROM ep e JOIN life x ON x.case_id = e.case_id AND x.i BETWEEN e.span_start AND e.span_end"""
)
def denial_lifecycle(spark, sf_dir):
    return denials.analyse(artefacts(spark, sf_dir))["lifecycle"].select("case_id", "denial_event_id", "position", "kind", "event_id")


PICTURES = """dumps AS (SELECT case_id, gap, arg_max(k, i) AS available_mb, arg_max(event_id % 3 = 0, i) AS releasable FROM a WHERE event_type = 'click' AND event_id % 2 = 0 GROUP BY 1, 2),
pic AS (SELECT e.case_id, e.id AS denial, CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE e.k END AS k, available_mb, coalesce(releasable, false) AS releasable FROM ep e LEFT JOIN dumps USING (case_id, gap)),
flag AS (
  SELECT case_id, denial, 0 AS position, 'working_set_pct_virtual' AS dimension, round(k * 15.0 / 2048 * 100, 1) AS v, 20 AS warn, 40 AS crit, true AS live, false AS inverse FROM pic WHERE k IS NOT NULL
  UNION ALL SELECT case_id, denial, 1, 'other_processes_pct_physical', round(k * 1.0 / 1000 * 100, 1), 10, 20, true, false FROM pic WHERE k IS NOT NULL
  UNION ALL SELECT case_id, denial, 2, 'cube_mmf_coverage', round(k * 10.0 / 2048 * 100, 1), 25, 40, k = 0, false FROM pic WHERE k IS NOT NULL
  UNION ALL SELECT case_id, denial, 3, 'smartheap_releasable', round(k * 3.0 / 2048 * 100, 1), 5, 15, NOT releasable, false FROM pic WHERE k IS NOT NULL
  UNION ALL SELECT case_id, denial, 4, 'system_free_headroom_pct', round(available_mb * 1.0 / 1000 * 100, 1), 20, 5, true, true FROM pic WHERE available_mb IS NOT NULL)"""


@query(f"WITH {DENIALS}, {PICTURES} SELECT case_id, denial AS denial_event_id, position, dimension, CAST(v AS DECIMAL(18,1)) AS value_pct, CASE WHEN inverse THEN CASE WHEN v <= crit THEN 'critical' WHEN v <= warn THEN 'warn' ELSE 'info' END WHEN NOT live THEN 'info' WHEN v >= crit THEN 'critical' WHEN v >= warn THEN 'warn' ELSE 'info' END AS severity FROM flag")
def denial_flags(spark, sf_dir):
    return denials.analyse(artefacts(spark, sf_dir))["flags"].select("case_id", "denial_event_id", "position", "dimension", F.col("value_pct").cast("decimal(18,1)").alias("value_pct"), "severity")


@query(
    f"""WITH {DENIALS}, g AS (SELECT g.* FROM grants g JOIN win USING (case_id, denial) WHERE g.i >= win.start_i), x AS (SELECT *, unnest([{{'d': 'oid', 'v': oid}}, {{'d': 'source', 'v': source_key}}, {{'d': 'sid', 'v': sid}}]) AS u FROM g WHERE matched)
SELECT case_id, denial AS denial_event_id, u.d AS dimension, u.v AS key, CAST(sum(size) AS DECIMAL(38,0)) AS granted_bytes, count(*) AS request_count, list(id ORDER BY i) AS event_ids, CASE WHEN u.d = 'oid' THEN len(list_distinct(list(sid))) ELSE 0 END AS n_sids FROM x GROUP BY 1, 2, 3, 4"""
)
def denial_attribution(spark, sf_dir):
    rows = denials.analyse(artefacts(spark, sf_dir))["attribution"]
    return rows.select("case_id", "denial_event_id", "dimension", "key", "granted_bytes", "request_count", "event_ids", F.size("sids").cast("long").alias("n_sids"))


@query(f"WITH {DENIALS} SELECT case_id, denial AS denial_event_id, list(id ORDER BY i) AS event_ids FROM grants g JOIN win USING (case_id, denial) WHERE g.i >= win.start_i AND NOT matched GROUP BY 1, 2")
def denial_unmatched(spark, sf_dir):
    return denials.analyse(artefacts(spark, sf_dir))["unmatched"]


@query(f"WITH {DENIALS} SELECT e.case_id, e.id AS denial_event_id, l.id AS event_id, CAST(row_number() OVER (PARTITION BY e.case_id, e.id ORDER BY l.i) - 1 AS INTEGER) AS position FROM ep e JOIN l ON l.case_id = e.case_id AND l.i BETWEEN e.span_start AND e.span_end")
def denial_span_events(spark, sf_dir):
    events = artefacts(spark, sf_dir)
    return denials.span_events(events, denials.detect(denials.marker_lines(events))).select("case_id", "denial_event_id", "event_id", "position")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE md5('o' || CAST(event_id % 7 AS VARCHAR)) END AS oid, md5('s' || CAST(event_id % 5 AS VARCHAR)) AS sid, CAST(round(value * 100) AS DECIMAL(38,0)) AS size, 'S' || CAST(event_id % 3 AS VARCHAR) AS source_key, CAST(floor(value * 1000) AS DECIMAL(38,0)) AS available, CAST(floor(value * 3000) AS DECIMAL(38,0)) AS hwm FROM events WHERE event_type = 'purchase'")
def grant_fields(spark, sf_dir):
    return denials.marker_lines(artefacts(spark, sf_dir)).where("success").select("event_id", "oid", "sid", "size", "source_key", "available", "hwm")


SPANS = f"""{DENIALS}, sp AS (SELECT e.case_id, e.id AS span_id, e.ts AS end_ts, coalesce(win.start_id, f.id) AS start_id, coalesce(st.ts, f.ts) AS start_ts FROM ep e JOIN win ON win.case_id = e.case_id AND win.denial = e.id
  LEFT JOIN l st ON st.case_id = e.case_id AND st.id = win.start_id LEFT JOIN l f ON f.case_id = e.case_id AND f.i = e.span_start),
v AS (SELECT *, CAST(floor(value / 60) AS DOUBLE) AS den FROM b WHERE event_type = 'view'),
vt AS (SELECT * FROM v WHERE event_id % 17 <> 0),
j AS (SELECT sp.*, v.id, v.ts, v.event_id, v.den, v.k FROM sp LEFT JOIN vt v ON v.case_id = sp.case_id AND v.ts BETWEEN start_ts AND end_ts),
nod AS (SELECT v.* FROM v WHERE case_id NOT IN (SELECT case_id FROM ep)), late AS (SELECT * FROM v WHERE event_id % 17 = 0)"""


def _counters(spark, sf_dir) -> dict[str, DataFrame]:
    events = artefacts(spark, sf_dir)
    found = denials.analyse(events, keep=DataFrame.persist)
    return counters.analyse(events, found, denials.span_events(events, found["episodes"]), bucket_seconds=86400, keep=DataFrame.persist)


@query(
    f"""WITH {SPANS} SELECT case_id, 'episode' AS scope, span_id AS key, count(id) AS sample_count, [any_value(start_id), span_id] AS boundary_event_ids FROM j GROUP BY case_id, span_id
UNION ALL SELECT DISTINCT case_id, 'file', '<unattributed>', 0, CAST([] AS VARCHAR[]) FROM late WHERE case_id IN (SELECT case_id FROM ep)
UNION ALL SELECT case_id, 'file', 'perf.csv', count(*) FILTER (WHERE event_id % 17 <> 0), CASE WHEN count(*) FILTER (WHERE event_id % 17 <> 0) > 0 THEN [arg_min(id, ts) FILTER (WHERE event_id % 17 <> 0), arg_max(id, ts) FILTER (WHERE event_id % 17 <> 0)] ELSE [] END FROM nod GROUP BY case_id"""
)
def counter_groups(spark, sf_dir):
    return _counters(spark, sf_dir)["groups"].select("case_id", "scope", "key", "sample_count", "boundary_event_ids")


@query(
    f"""WITH {SPANS}, reach AS (SELECT case_id, arg_min(id, ts) AS f, arg_max(id, ts) AS t FROM vt GROUP BY 1)
SELECT j.case_id, 'episode' AS scope, span_id AS key, 'non_overlap' AS dimension, 'critical' AS severity, CAST(NULL AS DOUBLE) AS value, CAST(len(list_distinct([any_value(start_id), span_id, any_value(f), any_value(t)])) AS INTEGER) AS n_ids FROM j LEFT JOIN reach USING (case_id) GROUP BY j.case_id, span_id HAVING count(id) = 0
UNION ALL SELECT case_id, 'episode', span_id, 'denial_always_zero', 'warn', 0.0, CAST(least(10, count(*) + 1) AS INTEGER) FROM j WHERE id IS NOT NULL GROUP BY case_id, span_id HAVING bool_and(den = 0)
UNION ALL SELECT case_id, 'episode', span_id, 'counter_set_drift', 'warn', CAST(count(*) AS DOUBLE), CAST(least(10, count(*)) AS INTEGER) FROM j WHERE id IS NOT NULL AND event_id % 19 = 0 GROUP BY case_id, span_id
UNION ALL SELECT case_id, 'file', 'perf.csv', 'counter_set_drift', 'warn', CAST(count(*) AS DOUBLE), CAST(least(10, count(*)) AS INTEGER) FROM nod WHERE event_id % 17 <> 0 AND event_id % 19 = 0 GROUP BY case_id
UNION ALL SELECT case_id, 'file', CASE WHEN case_id IN (SELECT case_id FROM ep) THEN '<unattributed>' ELSE 'perf.csv' END, 'unplaceable_samples', 'info', CAST(count(*) AS DOUBLE), CAST(least(10, count(*)) AS INTEGER) FROM late GROUP BY case_id"""
)
def counter_hazards(spark, sf_dir):
    return _counters(spark, sf_dir)["hazards"].select("case_id", "scope", "key", "dimension", "severity", "value", F.size("event_ids").alias("n_ids"))


@query(
    f"""WITH {SPANS}, x AS (SELECT case_id, span_id AS key, ts, id, CASE WHEN event_id % 23 <> 0 THEN CAST(k AS DOUBLE) END AS val FROM j WHERE id IS NOT NULL)
SELECT case_id, key, count(*) AS sample_count, count(*) - count(val) AS excluded_samples, arg_max(val, ts) AS at_denial, arg_max(id, ts) FILTER (WHERE val IS NOT NULL) AS at_denial_event_id, max(val) AS peak, arg_min(id, row(-val, ts)) FILTER (WHERE val IS NOT NULL) AS peak_event_id FROM x GROUP BY 1, 2"""
)
def counter_span_trends(spark, sf_dir):
    rows = _counters(spark, sf_dir)["counters"].where("scope = 'episode' and counter = 'Size(MB)'")
    return rows.select("case_id", "key", "sample_count", "excluded_samples", "at_denial", "at_denial_event_id", "peak", "peak_event_id")


@query(f"WITH {SPANS} SELECT case_id, span_id AS denial_event_id, start_id AS start_event_id, start_ts, end_ts, CAST(NULL AS VARCHAR) AS reason FROM sp")
def span_resolution(spark, sf_dir):
    events = artefacts(spark, sf_dir)
    found = denials.analyse(events)
    rows = counters.resolve_spans(found["windows"], found["episodes"], events, denials.span_events(events, found["episodes"]))
    return rows.select("case_id", F.col("span_id").alias("denial_event_id"), "start_event_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "reason")


@query(f"WITH {BASE} SELECT case_id, 'perf.csv' AS source_file, CAST(0 AS INTEGER) AS position FROM b WHERE event_type = 'view' GROUP BY 1")
def counter_file_order(spark, sf_dir):
    return counters.file_order(artefacts(spark, sf_dir))


@query(f"WITH {DENIALS}, g AS (SELECT g.* FROM grants g JOIN win USING (case_id, denial) WHERE g.i >= win.start_i AND matched), x AS (SELECT *, unnest([{{'d': 'oid', 'v': oid}}, {{'d': 'source', 'v': source_key}}, {{'d': 'sid', 'v': sid}}]) AS u FROM g) SELECT denial AS episode_id, u.d AS dimension, u.v AS key, CAST(sum(size) AS DECIMAL(38,0)) AS granted_bytes, CAST(round(CAST(sum(size) AS DOUBLE) / 1048576, 3) AS DECIMAL(18,3)) AS granted_mb, count(*) AS request_count, string_agg(id, ';' ORDER BY i) AS event_ids FROM x GROUP BY case_id, denial, u.d, u.v")
def attribution_csv(spark, sf_dir):
    return tables.attribution_rows(denials.analyse(artefacts(spark, sf_dir))).withColumn("granted_mb", F.col("granted_mb").cast("decimal(18,3)"))


@query(f"WITH {SPANS}, c AS (SELECT case_id, span_id, count(id) AS n FROM j GROUP BY 1, 2) SELECT span_id AS group_key, 'episode' AS group_scope, counter, n AS sample_count FROM c, (SELECT unnest(['Object(A)\\Total MCM Denial', 'Size(MB)']) AS counter) WHERE n > 0 UNION ALL SELECT span_id, 'episode', NULL, 0 FROM c WHERE n = 0")
def trend_csv(spark, sf_dir):
    return tables.trend_rows(_counters(spark, sf_dir)).where("group_scope = 'episode'").select("group_key", "group_scope", "counter", F.col("sample_count").cast("long").alias("sample_count"))


@query(f"WITH {DENIALS}, {PICTURES}, sev AS (SELECT *, CASE WHEN inverse THEN CASE WHEN v <= crit THEN 0 WHEN v <= warn THEN 1 ELSE 2 END WHEN NOT live THEN 2 WHEN v >= crit THEN 0 WHEN v >= warn THEN 1 ELSE 2 END AS lv FROM flag), worst AS (SELECT case_id, denial, min(lv) AS lv FROM sev GROUP BY 1, 2), r AS (SELECT e.case_id, e.id, row_number() OVER (PARTITION BY e.case_id ORDER BY coalesce(lv, 3), e.i) AS g FROM ep e LEFT JOIN worst w ON w.case_id = e.case_id AND w.denial = e.id) SELECT case_id, id AS event_id FROM r WHERE g <= 8 UNION SELECT x.case_id, x.first_id FROM (SELECT case_id, denial, u.d, u.v, arg_min(id, i) AS first_id, row_number() OVER (PARTITION BY case_id, denial, u.d ORDER BY sum(size) DESC, u.v) AS n FROM (SELECT g.*, unnest([{{'d': 'oid', 'v': oid}}, {{'d': 'source', 'v': source_key}}, {{'d': 'sid', 'v': sid}}]) AS u FROM grants g JOIN win USING (case_id, denial) WHERE g.i >= win.start_i AND matched) GROUP BY case_id, denial, u.d, u.v) x JOIN r ON r.case_id = x.case_id AND r.id = x.denial WHERE n <= 5 AND g <= 8")
def denial_fact_ids(spark, sf_dir):
    return facts.cited_ids(facts.denial_facts(denials.analyse(artefacts(spark, sf_dir), keep=DataFrame.persist)))


# Stacks


def _classified(spark, sf_dir) -> DataFrame:
    return stacks.classify(stacks.signatures(threads(spark, sf_dir)), RULES)


def dump_records(spark, sf_dir) -> DataFrame:
    """The conversations as thread records of raw text: each turn's role is a frame."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit("  0x0f "), F.col("role"), F.lit("@@V1 - lib.so x.c:3"))
    rows = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("frames"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("conv_id").cast("string").alias("event_id"), F.lit("case").alias("case_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit("missing").alias("ts_confidence"), F.lit("eustack").alias("source"), F.concat(F.lit("dump"), (F.col("conv_id") % 3).cast("string")).alias("source_file"),
        F.col("conv_id").cast("int").alias("line_start"), F.col("conv_id").cast("int").alias("line_end"), F.lit("unknown").alias("severity"), none.alias("component"), F.col("conv_id").cast("string").alias("thread"), none.alias("session"), F.lit("").alias("message"),
        F.create_map().cast("map<string,string>").alias("attrs"), F.concat(F.lit("TID "), F.col("conv_id").cast("string"), F.lit(":\n"), F.col("frames"), F.lit("\nnot a frame")).alias("raw"),
    )


@query(f"WITH {SIGNATURES} SELECT CAST(conv_id AS VARCHAR) AS thread, dump, frames FROM th")
def thread_frames(spark, sf_dir):
    return stacks.threads_of(dump_records(spark, sf_dir)).select("thread", "dump", "frames")


@query(f"WITH {SIGNATURES} SELECT dump, count(*) AS thread_count, CAST(right(dump, 1) AS INTEGER) AS dump_idx, dump = 'dump2' AS latest FROM th GROUP BY 1")
def stack_dumps(spark, sf_dir):
    return stacks.analyse(dump_records(spark, sf_dir), RULES)["dumps"].select("dump", "thread_count", "dump_idx", "latest")


@query("SELECT 'case' AS case_id, 'filename' AS basis, 'ordering_unverified' AS flag")
def stack_order_basis(spark, sf_dir):
    return stacks.analyse(dump_records(spark, sf_dir), RULES)["basis"]


@query(
    f"""WITH {SIGNATURES}, t AS (SELECT dump, sum(thread_count) AS n, sum(CASE WHEN role = 'unclassified' THEN thread_count ELSE 0 END) AS u FROM cl GROUP BY 1), s AS (SELECT dump, sum(thread_count) AS n FROM cl WHERE role = 'blocked-on-lock' GROUP BY 1),
f AS (SELECT dump, 0 AS position, 'unclassified_thread_pct' AS dimension, round(u * 100.0 / n, 1) AS v, 5 AS warn, 15 AS crit FROM t UNION ALL SELECT dump, 1, 'no_resolvable_frame_pct', 0, 5, 15 FROM t UNION ALL SELECT dump, 2, 'lock_convergence_count', n, 5, 20 FROM s)
SELECT 'case' AS case_id, dump, position, dimension, CAST(v AS DECIMAL(18,1)) AS value, CASE WHEN v >= crit THEN 'critical' WHEN v >= warn THEN 'warn' ELSE 'info' END AS severity FROM f"""
)
def saturation_flags(spark, sf_dir):
    return stacks.saturation_flags(_classified(spark, sf_dir)).select("case_id", "dump", F.col("position").cast("int").alias("position"), "dimension", F.col("value").cast("decimal(18,1)").alias("value"), "severity")


@query(f"WITH {SIGNATURES}, x AS (SELECT frames, any_value(role) AS role, any_value(subsystem) AS subsystem FROM cl GROUP BY 1) SELECT 'case' AS case_id, frames, role, subsystem, frames[1] AS leaf_frame FROM x")
def last_classification(spark, sf_dir):
    rows = stacks.signatures(threads(spark, sf_dir))
    order = stacks.dump_order(rows.select("case_id", "dump").distinct().withColumn("ts", F.lit(None).cast("timestamp")))
    return stacks.last_seen(stacks.classify(rows, RULES), order).select("case_id", "frames", "role", "subsystem", "leaf_frame")


def _progression(spark, sf_dir) -> DataFrame:
    rows = stacks.signatures(threads(spark, sf_dir))
    return stacks.progression(rows, stacks.dump_order(rows.select("case_id", "dump").distinct().withColumn("ts", F.lit(None).cast("timestamp"))))


WIDE = "wide AS (SELECT frames, CAST(coalesce(sum(thread_count) FILTER (WHERE dump = 'dump0'), 0) AS BIGINT) AS a, CAST(coalesce(sum(thread_count) FILTER (WHERE dump = 'dump1'), 0) AS BIGINT) AS b, CAST(coalesce(sum(thread_count) FILTER (WHERE dump = 'dump2'), 0) AS BIGINT) AS c FROM sig GROUP BY 1)"


@query(f"WITH {SIGNATURES}, {WIDE} SELECT 'case' AS case_id, frames, c - a AS overall_delta FROM wide WHERE a <> b OR b <> c")
def changed_signatures(spark, sf_dir):
    return stacks.changed(_progression(spark, sf_dir)).select("case_id", "frames", "overall_delta")


@query(f"WITH {SIGNATURES}, {WIDE} SELECT 'case' AS case_id, count(*) FILTER (WHERE a <> b OR b <> c) AS changed, count(*) AS signatures FROM wide HAVING count(*) > 0")
def changed_signature_count(spark, sf_dir):
    return stacks.changed_count(_progression(spark, sf_dir))


@query(f"WITH {SIGNATURES}, {WIDE} SELECT 'case' AS case_id, frames, a AS dump0, b AS dump1, c AS dump2 FROM wide")
def signature_pivot(spark, sf_dir):
    return tables.pivoted(stacks.signatures(threads(spark, sf_dir)), ["dump0", "dump1", "dump2"])


@query(f"WITH {SIGNATURES}, {WIDE} SELECT array_to_string(frames, ' ') AS frames, role, c AS thread_count, a AS dump0, b AS dump1, c AS dump2, CASE WHEN b < a THEN '''' ELSE '' END || CAST(b - a AS VARCHAR) || ';' || CAST(c - b AS VARCHAR) AS step_deltas, c - a AS overall_delta FROM wide JOIN (SELECT frames, any_value(role) AS role FROM cl GROUP BY 1) USING (frames)")
def signatures_csv(spark, sf_dir):
    found = stacks.analyse(dump_records(spark, sf_dir), RULES)
    # The frames name the rows here; the table itself has matched and leaf frame.
    named = dict(found, progression=found["progression"].withColumn("leaf_frame", F.array_join("frames", " ")))
    return tables.signature_rows(named).select(F.col("leaf_frame").alias("frames"), "role", "thread_count", "dump0", "dump1", "dump2", "step_deltas", "overall_delta")


@query(f"WITH {SIGNATURES} SELECT 'case' AS case_id, dump, frames, count(*) AS population, list(CAST(conv_id AS VARCHAR) ORDER BY CAST(conv_id AS VARCHAR))[1:3] AS exemplars FROM th GROUP BY dump, frames")
def signature_exemplars(spark, sf_dir):
    return stacks.signature_exemplars(stacks.threads_of(dump_records(spark, sf_dir)))


@query(f"WITH {SIGNATURES}, p AS (SELECT dump, subsystem, sum(thread_count) AS total FROM cl GROUP BY 1, 2) SELECT dump, subsystem, CAST(row_number() OVER (PARTITION BY dump ORDER BY total DESC, subsystem IS NULL, subsystem) AS INTEGER) AS place FROM p")
def pool_order(spark, sf_dir):
    return tables.numbered(stacks.pools(_classified(spark, sf_dir)).withColumn("case_id", F.col("dump")), stacks.report_order("pools")).select("dump", "subsystem", F.col("row").alias("place"))


@query(f"WITH {SIGNATURES} SELECT dump, frames, CAST(row_number() OVER (PARTITION BY dump ORDER BY thread_count DESC, frames) AS INTEGER) AS place FROM sig")
def signature_order(spark, sf_dir):
    return tables.numbered(stacks.signatures(threads(spark, sf_dir)).withColumn("case_id", F.col("dump")), stacks.report_order("signatures")).select("dump", "frames", F.col("row").alias("place"))


@query(f"WITH {SIGNATURES}, {WIDE} SELECT frames, CAST(row_number() OVER (ORDER BY abs(c - a) DESC, c DESC, frames) AS INTEGER) AS place FROM wide")
def progression_order(spark, sf_dir):
    return tables.numbered(_progression(spark, sf_dir), stacks.report_order("progression")).select("frames", F.col("row").alias("place"))


# Clusters and salience


def _groups(spark, sf_dir) -> DataFrame:
    return templates.template_groups(canonical(spark, sf_dir))


def _clusters(spark, sf_dir) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return clusters.build(groups, groups.select("case_id", "template_id", F.length("template").cast("long").alias("cluster_id")))


BUILT = f"""{EVENTS}, {GROUPS}, n AS (SELECT *, substr(sha256(template), 1, 16) AS template_id, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, template) - 1 AS pos FROM groups_c),
cl_c AS (SELECT case_id, length(template) AS cluster_id, CAST(sum(n) AS BIGINT) AS count, max(rank) AS rank, arg_max(template, row(rank, n, -pos)) AS signature, arg_max(ids[1], row(rank, n, -pos)) AS exemplar_event_id, list(template_id ORDER BY pos) AS template_ids, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM n GROUP BY 1, 2)"""


@query(f"WITH {BUILT} SELECT case_id, cluster_id, signature, CASE rank WHEN 5 THEN 'fatal' WHEN 4 THEN 'error' WHEN 3 THEN 'warn' WHEN 2 THEN 'info' WHEN 1 THEN 'debug' ELSE 'unknown' END AS severity_max, count, template_ids, exemplar_event_id FROM cl_c")
def cluster_build(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query(f"WITH {BUILT} SELECT case_id, cluster_id, first_ts, last_ts FROM cl_c")
def cluster_spans(spark, sf_dir):
    return clusters.with_spans(_clusters(spark, sf_dir), _groups(spark, sf_dir)).select("case_id", "cluster_id", "first_ts", "last_ts")


@query(f"WITH {BUILT} SELECT case_id, template_id, CAST(pos AS INTEGER) AS pos FROM n")
def template_group_order(spark, sf_dir):
    return clusters.numbered_groups(_groups(spark, sf_dir)).select("case_id", "template_id", "pos")


@query(f"WITH {BUILT} SELECT case_id, cluster_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY count DESC, cluster_id) AS INTEGER) AS place FROM cl_c")
def cluster_order(spark, sf_dir):
    return tables.numbered(_clusters(spark, sf_dir), clusters.cluster_order()).select("case_id", "cluster_id", F.col("row").alias("place"))


@query(f"WITH {BUILT} SELECT n.case_id, template_id, coalesce(e.message, template) AS text FROM n LEFT JOIN events_c e ON e.event_id = ids[1]")
def exemplar_texts(spark, sf_dir):
    return clusters.exemplar_texts(_groups(spark, sf_dir), canonical(spark, sf_dir)).select("case_id", "template_id", "text")


SCORED = f"""{BUILT}, s AS (SELECT *, epoch_us(first_ts) / 1e6 AS f, epoch_us(last_ts) / 1e6 AS l, count / greatest((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6, 1.0) AS raw FROM cl_c),
c AS (SELECT case_id, max(count) AS top, min(raw) AS low, max(raw) AS high, max(l) AS fin, max(l) - min(f) AS span FROM s GROUP BY 1),
x AS (SELECT s.*, 0.35 * rank / 5 + 0.20 * ln(1 + count) / ln(1 + greatest(top, 1)) + 0.15 * CASE WHEN high > low THEN (raw - low) / (high - low) ELSE 0 END
  + 0.10 * exp(-abs(f - fin) / CASE WHEN span > 0 THEN span / 4 ELSE 3600 END) + 0.20 * exp(-abs(l - fin) / CASE WHEN span > 0 THEN span / 4 ELSE 3600 END) AS score FROM s JOIN c USING (case_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, cluster_id) AS rk FROM x)"""


def _scored(spark, sf_dir) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return templates.salience(clusters.with_spans(_clusters(spark, sf_dir), groups))


@query(f"WITH {SCORED} SELECT case_id, cluster_id, CAST(rk AS INTEGER) AS rank FROM ranked")
def cluster_rank(spark, sf_dir):
    return _scored(spark, sf_dir).select("case_id", "cluster_id", "rank")


@query(f"WITH {SCORED} SELECT case_id, cluster_id, CAST((row_number() OVER (PARTITION BY case_id ORDER BY cluster_id) - 1) // 2 AS INTEGER) AS request FROM ranked WHERE rk <= 5")
def clusters_to_label(spark, sf_dir):
    return clusters.to_label(_scored(spark, sf_dir), 5, 2).select("case_id", "cluster_id", "request")


@query(f"WITH {SCORED}, m AS (SELECT r.case_id, rk, e.event_id, e.message, greatest(1, length(e.message) // 4) AS est FROM ranked r JOIN events_c e ON e.event_id = r.exemplar_event_id AND e.case_id = r.case_id WHERE rk <= 4), t AS (SELECT case_id, sum(est) AS total, count(*) AS cnt FROM m GROUP BY 1) SELECT case_id, CAST(rk AS INTEGER) AS rank, event_id, CASE WHEN total > 12 THEN left(message, CAST(greatest(1, 12 // cnt) * 4 AS BIGINT)) ELSE message END AS excerpt FROM m JOIN t USING (case_id)")
def shown_clusters(spark, sf_dir):
    return triage.shown_clusters(_scored(spark, sf_dir), canonical(spark, sf_dir), top=4, budget=12).select("case_id", "rank", "event_id", "excerpt")


@query("SELECT d.text, arg_max(CAST(e.label AS BIGINT), d.doc_id) AS label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1")
def vectors_by_text(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.array(F.col("label").cast("double")).alias("embedding"))
    return clusters.vectors_by_text(chunks, known).select("text", F.col("embedding")[0].cast("long").alias("label"))


@query("SELECT doc_id, doc_id % 2 = 0 AS reused, CASE WHEN doc_id % 2 = 0 THEN -1 ELSE CAST(length(text) AS BIGINT) END AS first FROM (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)")
def embedding_reuse(spark, sf_dir):
    first = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    known = first.where("doc_id % 2 = 0").select("text", F.array(F.lit(-1.0)).alias("embedding"))
    found = clusters.embed_with_reuse(first, known, lambda rows: rows.withColumn("embedding", F.array(F.length("text").cast("double"))))
    return found.select("doc_id", "reused", F.col("embedding")[0].cast("long").alias("first"))


@query(f"WITH {BUILT} SELECT case_id, cluster_id, CASE WHEN cluster_id % 2 = 0 THEN left('L' || signature, 80) ELSE 'old' END AS label FROM cl_c")
def label_update(spark, sf_dir):
    rows = _clusters(spark, sf_dir).withColumn("label", F.lit("old"))
    new = rows.where("cluster_id % 2 = 0").select("case_id", "cluster_id", F.concat(F.lit("L"), "signature").alias("label"))
    return clusters.with_labels(rows, new).select("case_id", "cluster_id", "label")


# Triage and evaluation


@query("SELECT user_id AS case_id, event_id AS hyp_index, event_id % 5 = 0 OR event_type IN ('view', 'click') AS citations_valid FROM events")
def citations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("case_id", F.col("user_id"))
    hypotheses = e.select("case_id", F.col("event_id").alias("hyp_index"), F.when(F.col("event_id") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array("event_id")).alias("supporting_event_ids"))
    return triage.citations_valid(hypotheses, e.where("event_type in ('view', 'click')").select("case_id", "event_id")).select("case_id", "hyp_index", "citations_valid")


@query("SELECT DISTINCT user_id AS case_id, event_id FROM events WHERE event_type IN ('view', 'error') OR value > 60")
def prompted_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("case_id", F.col("user_id"))
    return triage.prompted_ids(e.where("event_type = 'view'"), e.where("event_type = 'error'"), e.where("value > 60"))


def _targets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    levels = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("target_type"), F.col("o_orderkey").cast("string").alias("target_id"))
    verdicts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("target_id"))
    return levels, verdicts.join(levels, "target_id").unionByName(verdicts.select("target_id", F.lit("gone").alias("target_type")))


@query("SELECT o_orderstatus AS target_type, count(*) AS total, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS ruled FROM orders GROUP BY 1")
def verdict_progress(spark, sf_dir):
    return progress(*_targets(spark, sf_dir))


def _hypotheses(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("case_id"), (F.col("doc_id") % 5).cast("int").alias("hyp_index"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("narrative"), F.when(F.col("doc_id") % 7 == 0, "high").otherwise("low").alias("confidence"), (F.col("doc_id") % 3 > 0).alias("citations_valid"))


@query("SELECT lang AS case_id, CASE WHEN bool_or(doc_id % 5 < 3 AND (contains(lower(left(text, 20) || chr(10) || text), 'ing') OR contains(lower(text), 'zzqq'))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hypothesis_hit_at_k FROM documents GROUP BY 1")
def hit_at_k(spark, sf_dir):
    keywords = table(spark, sf_dir, "documents").select(F.col("lang").alias("case_id")).distinct().withColumn("keyword", F.explode(F.array(F.lit("ING"), F.lit("zzqq"))))
    return evaluation.hit_at_k(_hypotheses(spark, sf_dir), keywords)


@query("SELECT lang AS case_id, CAST(((CASE WHEN bool_or(contains(text, '%')) THEN 1 ELSE 0 END) + (CASE WHEN bool_or(regexp_matches(text, '[0-9]{3}')) THEN 1 ELSE 0 END) + 0) / 3.0 AS DECIMAL(18,6)) AS retrieval_hit_rate FROM documents GROUP BY 1")
def retrieval_hit_rate(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("lang").alias("case_id"), "text")
    patterns = texts.select("case_id").distinct().withColumn("pattern", F.explode(F.array(F.lit("%"), F.lit("[0-9]{3}"), F.lit("zzqq+"))))
    return evaluation.retrieval_hit_rate(texts, patterns).withColumn("retrieval_hit_rate", F.col("retrieval_hit_rate").cast("decimal(18,6)"))


@query("SELECT lang AS case_id, CAST(avg(CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.0 END) AS DECIMAL(18,6)) AS citation_validity_rate FROM documents GROUP BY 1")
def citation_validity(spark, sf_dir):
    rows = _hypotheses(spark, sf_dir)
    return evaluation.citation_validity(rows, rows).withColumn("citation_validity_rate", F.col("citation_validity_rate").cast("decimal(18,6)"))


@query("SELECT lang AS case_id, bool_and(doc_id % 7 <> 0) AS negative_case_pass FROM documents GROUP BY 1")
def negative_cases(spark, sf_dir):
    rows = _hypotheses(spark, sf_dir)
    return evaluation.negative_pass(rows, rows)


@query("SELECT lang AS case_id, CASE WHEN count(DISTINCT source) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS determinism_stability FROM documents GROUP BY 1")
def determinism(spark, sf_dir):
    rows = evaluation.determinism(table(spark, sf_dir, "documents").select(F.col("lang").alias("case_id"), F.col("source").alias("document")))
    return rows


def _cases(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    figure = lambda k: (n % k) / F.lit(float(k))
    return table(spark, sf_dir, "labels").select(
        n.cast("string").alias("name"), figure(10).alias("retrieval_hit_rate"), (F.col("quality") == 1).cast("double").alias("hypothesis_hit_at_k"), figure(4).alias("citation_validity_rate"), F.lit(1.0).alias("determinism_stability"), (F.col("toxic") == 1).alias("expect_no_incident"), (n % 2 == 0).alias("negative_case_pass"),
        (n % 9 == 0).alias("run_failed"), (n % 5 == 0).alias("is_eustack"), (n % 10 == 0).alias("eustack_case_pass"),
    )


SUITE = """s AS (SELECT doc_id AS n, quality, toxic = 1 AS neg, doc_id % 9 = 0 AS failed, doc_id % 5 = 0 AS st FROM labels),
m AS (SELECT coalesce(avg(n % 10 / 10.0) FILTER (WHERE NOT failed AND NOT st AND NOT neg), 1) AS a, coalesce(avg(CAST(quality = 1 AS INTEGER)) FILTER (WHERE NOT failed AND NOT st AND NOT neg), 1) AS b, coalesce(avg(n % 4 / 4.0) FILTER (WHERE NOT failed AND NOT st), 1) AS c, 1.0 AS d,
  coalesce(avg(CAST(n % 10 = 0 AS INTEGER)) FILTER (WHERE NOT failed AND st), 1) AS e, count(*) FILTER (WHERE failed) AS f, count(*) FILTER (WHERE NOT failed AND neg AND n % 2 <> 0) AS fp FROM s)"""


@query(f"WITH {SUITE}, r AS (SELECT unnest([{{'n': 'retrieval_hit_rate', 'v': CAST(a AS DOUBLE), 'p': a >= 0.4}}, {{'n': 'hypothesis_hit_at_k', 'v': CAST(b AS DOUBLE), 'p': b >= 0.4}}, {{'n': 'citation_validity_rate', 'v': CAST(c AS DOUBLE), 'p': c >= 0.4}}, {{'n': 'determinism_stability', 'v': CAST(d AS DOUBLE), 'p': d >= 0.4}}, {{'n': 'eustack_detection_rate', 'v': CAST(e AS DOUBLE), 'p': e >= 0.4}}, {{'n': 'gate', 'v': NULL, 'p': f = 0 AND fp = 0}}]) AS u FROM m) SELECT u.n AS name, CAST(u.v AS DECIMAL(18,6)) AS value, u.p AS passed FROM r")
def suite_gate(spark, sf_dir):
    rows = evaluation.gate(evaluation.suite_means(_cases(spark, sf_dir)), dict.fromkeys(evaluation.METRICS, 0.4))
    return rows.select("name", F.col("value").cast("decimal(18,6)").alias("value"), "passed")


# Rows, orders and texts


@query(f"WITH {EVENTS} SELECT event_id, message FROM events_c WHERE case_id = 'c1' AND severity = 'error' AND line_start % 100 = 7")
def point_lookup(spark, sf_dir):
    e = canonical(spark, sf_dir)
    ids = e.where("case_id = 'c1' and severity = 'error' and line_start % 100 = 7").select("event_id")
    return e.join(ids, "event_id", "left_semi").select("event_id", "message")


@query("SELECT user_id AS case_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events")
def verdict_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), "event_id", "ts")
    return tables.numbered(rows, [F.desc("ts"), F.desc("event_id")]).select("case_id", "event_id", F.col("row").alias("place"))


@query(f"WITH {EVENTS}, g AS (SELECT case_id, regexp_replace(message, '\\b\\d+\\b', '<NUM>', 'g') AS template, count(*) AS n, max(rank) AS r FROM events_c GROUP BY 1, 2) SELECT case_id, template, n AS count FROM g WHERE r = 4 AND n >= 3 AND contains(template, 'error took')")
def group_filters(spark, sf_dir):
    filters = ev.parse_filters(["severity=error", "min-count=3", "contains=error took"], ev.GROUP_FILTERS)
    return ev.apply_filters(_groups(spark, sf_dir), filters, ev.GROUP_FILTERS).select("case_id", "template", "count")


@query("SELECT event_id, ts AS iso, date_trunc('second', ts) AS syslog, date_trunc('second', ts) AS epoch, date_trunc('second', ts) AS clf FROM events")
def stamp_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    e = table(spark, sf_dir, "events").withColumns({
        "a": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSSSSS'Z'"), "b": F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.date_format(ts, "d HH:mm:ss"), F.lit(" host x")), "c": F.concat(F.unix_seconds(ts).cast("string"), F.lit(" y")), "d": F.concat(F.lit("["), F.date_format(ts, "d/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] z")),
    })
    found = {"iso": T.iso_moment(F.col("a")), "syslog": T.syslog_moment(F.col("b"), ts), "epoch": T.epoch_moment(F.col("c")), "clf": T.clf_moment(F.col("d"))}
    return e.select("event_id", *(c.cast("timestamp_ntz").alias(n) for n, c in found.items()))


@query(r"SELECT doc_id, CASE lower(regexp_extract(text, '(?i)\b(critical|warning|notice|error|fatal|debug|trace|crit|info|warn|fine|err)\b', 1)) WHEN 'fatal' THEN 'fatal' WHEN 'critical' THEN 'fatal' WHEN 'crit' THEN 'fatal' WHEN 'error' THEN 'error' WHEN 'err' THEN 'error' WHEN 'warning' THEN 'warn' WHEN 'warn' THEN 'warn' WHEN 'info' THEN 'info' WHEN 'notice' THEN 'info' WHEN 'debug' THEN 'debug' WHEN 'trace' THEN 'debug' WHEN 'fine' THEN 'debug' ELSE 'unknown' END AS severity, CASE WHEN regexp_matches(ltrim(text), '^[=+\-@]') THEN '''' || text ELSE text END AS safe FROM documents")
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.severity_of(F.col("text")).alias("severity"), T.csv_safe(F.col("text")).alias("safe"))


@query("SELECT event_id, [CAST(event_id AS VARCHAR), 'x'] AS listed, MAP {'k': regexp_extract(props, '(\\d+)', 1)} AS mapped, '[evt:' || CAST(event_id AS VARCHAR) || '][evt:x]' AS cited, CAST(round(value * 1000000 / 1048576, 3) AS DECIMAL(18,3)) AS mb FROM events")
def json_functions(spark, sf_dir):
    listed = T.string_list(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(', "x"]')))
    return table(spark, sf_dir, "events").select("event_id", listed.alias("listed"), T.string_map(F.col("props")).alias("mapped"), T.citation_prefix(listed).alias("cited"), T.mebibytes(F.col("value") * 1000000).cast("decimal(18,3)").alias("mb"))
