"""The query catalogue: name -> function of (spark, table folder), and the SQL that must give the same rows.

The driver's tables stand in for artefacts: `events` rows become canonical events (a user's events are one file and, for the
episode queries, one case: purchase is a success, error a denial, signup a return to normal, click a counter sample), the roles of a
conversation's turns are a thread's stack frames, `labels` are evaluation truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import episodes, events as ev, stacks, templates, vectors
from ..schema import severity_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    file = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "purchase", "info").when(F.col("event_type") == "click", "debug").otherwise("unknown")
    k = F.regexp_extract("props", r"(\d+)", 1)
    return e.select(
        T.event_identity(file, F.col("event_id") * 64).alias("event_id"), F.concat(F.lit("c"), F.pmod("user_id", F.lit(10)).cast("string")).alias("case_id"), "ts", F.col("event_type").alias("source"), file.alias("source_file"),
        F.col("event_id").cast("int").alias("line_start"), severity.alias("severity"), F.concat(F.col("event_type"), F.lit(" took "), k, F.lit(" ms for "), file).alias("message"),
    )


EVENTS = """events_c AS (
  SELECT substr(sha256('u' || CAST(user_id AS VARCHAR) || chr(0) || CAST(event_id * 64 AS VARCHAR)), 1, 16) AS event_id,
    'c' || CAST(user_id % 10 AS VARCHAR) AS case_id, ts, event_type AS source, 'u' || CAST(user_id AS VARCHAR) AS source_file, CAST(event_id AS INTEGER) AS line_start,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'unknown' END AS severity,
    CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS rank,
    event_type || ' took ' || regexp_extract(props, '(\\d+)', 1) || ' ms for u' || CAST(user_id AS VARCHAR) AS message FROM events)"""
GROUPS = """groups_c AS (
  SELECT case_id, regexp_replace(message, '\\b\\d+\\b', '<NUM>', 'g') AS template, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(rank) AS rank,
    list(event_id ORDER BY ts, source_file, line_start, event_id)[1:5] AS ids FROM events_c WHERE source NOT IN ('dssperfmon', 'eustack') GROUP BY 1, 2)"""
NAME = "CASE rank WHEN 5 THEN 'fatal' WHEN 4 THEN 'error' WHEN 3 THEN 'warn' WHEN 2 THEN 'info' WHEN 1 THEN 'debug' ELSE 'unknown' END"


@query("SELECT event_id AS id, substr(sha256('u' || CAST(user_id AS VARCHAR) || chr(0) || CAST(event_id * 64 AS VARCHAR)), 1, 16) AS identity FROM events")
def event_identity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), T.event_identity(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id") * 64).alias("identity"))


@query(f"WITH {EVENTS} SELECT event_id, ts, source_file, line_start, severity FROM events_c WHERE severity = 'error' AND contains(source_file, '1') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, source_file, line_start, event_id LIMIT 100")
def scan_filter_events(spark, sf_dir):
    filters = ev.parse_filters(["severity=error", "file=1", "since=2024-01-05", "until=2024-01-20", "limit=100"], ev.EVENT_FILTERS)
    return ev.query_events(canonical(spark, sf_dir), filters).select("event_id", "ts", "source_file", "line_start", "severity")


@query("SELECT doc_id FROM documents WHERE contains(text, '%') AND NOT contains(text, '_')")
def literal_contains_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").contains("%") & ~F.col("text").contains("_")).select("doc_id")


@query(f"WITH {EVENTS} SELECT source, count(*) AS n FROM events_c WHERE source NOT IN ('dssperfmon', 'eustack') GROUP BY 1")
def ranking_exclusion(spark, sf_dir):
    return ev.ranking_events(canonical(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT event_id, severity, CAST(rank AS INTEGER) AS severity_rank FROM events_c")
def project_severity_rank(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", "severity", severity_rank().alias("severity_rank"))


@query(f"WITH {EVENTS}, {GROUPS} SELECT case_id, substr(sha256(template), 1, 16) AS template_id, template, n AS count, first_ts, last_ts, {NAME} AS severity_max, ids AS exemplar_event_ids FROM groups_c")
def template_groups(spark, sf_dir):
    return templates.template_groups(canonical(spark, sf_dir))


@query()
def mask_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.mask("text").alias("masked"))


SCORE = """s AS (SELECT *, epoch_us(first_ts) / 1e6 AS f, epoch_us(last_ts) / 1e6 AS l, n / greatest((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6, 1.0) AS raw FROM groups_c),
c AS (SELECT case_id, max(n) AS top, min(raw) AS low, max(raw) AS high, max(l) AS fin, max(l) - min(f) AS span FROM s GROUP BY 1),
x AS (SELECT s.case_id, substr(sha256(template), 1, 16) AS cluster_id, 0.35 * rank / 5 + 0.20 * ln(1 + n) / ln(1 + greatest(top, 1)) + 0.15 * CASE WHEN high > low THEN (raw - low) / (high - low) ELSE 0 END
  + 0.10 * exp(-abs(f - fin) / CASE WHEN span > 0 THEN span / 4 ELSE 3600 END) + 0.20 * exp(-abs(l - fin) / CASE WHEN span > 0 THEN span / 4 ELSE 3600 END) AS score FROM s JOIN c USING (case_id))"""


@query(f"WITH {EVENTS}, {GROUPS}, {SCORE} SELECT case_id, cluster_id, round(CAST(score AS DECIMAL(38,12)), 6) AS score FROM x")
def salience_rank(spark, sf_dir):
    groups = templates.template_groups(canonical(spark, sf_dir)).withColumnRenamed("template_id", "cluster_id")
    return templates.salience(groups).select("case_id", "cluster_id", F.round(F.col("score").cast("decimal(38,12)"), 6).alias("score"))


@query(f"WITH {EVENTS}, {GROUPS} SELECT case_id, template, n AS count FROM groups_c WHERE last_ts >= TIMESTAMP '2024-01-10' AND first_ts <= TIMESTAMP '2024-01-12'")
def window_intersection(spark, sf_dir):
    groups = templates.template_groups(canonical(spark, sf_dir)).withColumnRenamed("template_id", "cluster_id")
    return templates.salience(groups, since="2024-01-10", until="2024-01-12").select("case_id", "template", "count")


def markers(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error", "signup", "click"))
    return e.select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("i"), "event_id", "ts", (F.col("event_type") == "purchase").alias("success"), (F.col("event_type") == "error").alias("denial"), (F.col("event_type") == "signup").alias("normal"), "event_type", "value"
    )


EPISODES = """m AS (SELECT user_id AS case_id, event_id AS i, event_id, ts, event_type, value FROM events WHERE event_type IN ('purchase', 'error', 'signup', 'click')),
a AS (SELECT *, coalesce(sum((event_type = 'signup')::INT) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
  sum((event_type = 'purchase')::INT) OVER (PARTITION BY case_id ORDER BY i) AS cs, min(i) OVER (PARTITION BY case_id) AS fi, max(i) OVER (PARTITION BY case_id) AS li FROM m),
b AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN i END) OVER (PARTITION BY case_id, seg) AS seg_end FROM a),
d AS (SELECT *, lag(cs) OVER (PARTITION BY case_id, seg ORDER BY i) AS p FROM b WHERE event_type = 'error'),
o AS (SELECT *, lead(i) OVER (PARTITION BY case_id, seg ORDER BY i) AS nx FROM d WHERE p IS NULL OR cs > p),
z AS (SELECT *, coalesce(nx - 1, seg_end, li) AS span_end FROM o),
episodes_c AS (SELECT case_id, event_id AS denial_event_id, ts AS denial_ts, i AS denial_i, CASE WHEN nx IS NULL THEN seg_end END AS recovery_event_id, nx IS NULL AND seg_end IS NULL AS open_truncated,
  coalesce(lag(span_end) OVER (PARTITION BY case_id ORDER BY i) + 1, fi) AS span_start, span_end FROM z)"""


@query(f"WITH {EPISODES} SELECT * FROM episodes_c")
def episode_detection(spark, sf_dir):
    return episodes.detect(markers(spark, sf_dir))


@query(
    f"""WITH {EPISODES}, q AS (SELECT e.case_id, denial_event_id, m.event_id, m.i, m.value,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY denial_event_id) AS n, last_value(m.value * 4) OVER (PARTITION BY denial_event_id ORDER BY m.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mark
  FROM episodes_c e JOIN m ON m.case_id = e.case_id AND m.i >= span_start AND m.i < denial_i AND event_type = 'click' WINDOW w AS (PARTITION BY denial_event_id ORDER BY m.i)),
r AS (SELECT denial_event_id, any_value(n) AS n, max(CASE WHEN value >= mark * 25 / 100 THEN rn END) AS above FROM q GROUP BY 1),
t AS (SELECT r.denial_event_id, r.n, q.event_id FROM r JOIN q ON q.denial_event_id = r.denial_event_id AND q.rn = CASE WHEN above IS NULL THEN 1 ELSE least(above + 1, r.n) END)
SELECT e.case_id, e.denial_event_id, 25 AS threshold_pct, t.event_id AS start_event_id, coalesce(t.n, 0) AS request_count FROM episodes_c e LEFT JOIN t ON t.denial_event_id = e.denial_event_id"""
)
def episode_descent_window(spark, sf_dir):
    m = markers(spark, sf_dir)
    samples = m.where("event_type = 'click'").select("case_id", "i", "event_id", F.col("value").alias("available"), (F.col("value") * 4).alias("hwm"))
    return episodes.descent_window(episodes.detect(m), samples)


ATTRIBUTION = f"""{EPISODES}, g AS (SELECT e.case_id, denial_event_id, CAST(CAST(m.value * 100 AS BIGINT) AS BIGINT) AS bytes, 'o' || CAST(m.i % 7 AS VARCHAR) AS oid, event_type AS source_key, 's' || CAST(m.i % 3 AS VARCHAR) AS sid
  FROM episodes_c e JOIN m ON m.case_id = e.case_id AND m.i >= span_start AND m.i < denial_i AND event_type IN ('click', 'purchase')),
attr AS (SELECT case_id, denial_event_id, CASE WHEN grouping(oid) = 0 THEN 'oid' WHEN grouping(source_key) = 0 THEN 'source' ELSE 'sid' END AS dimension, coalesce(oid, source_key, sid) AS key,
  CAST(sum(bytes) AS BIGINT) AS granted_bytes, count(*) AS request_count FROM g GROUP BY GROUPING SETS ((case_id, denial_event_id, oid), (case_id, denial_event_id, source_key), (case_id, denial_event_id, sid)))"""


def _attribution(spark, sf_dir) -> DataFrame:
    m = markers(spark, sf_dir)
    i = F.col("i")
    grants = m.where("event_type in ('click', 'purchase')").select(
        "case_id", "i", "event_id", F.round(F.col("value") * 100).cast("long").alias("bytes"), F.concat(F.lit("o"), (i % 7).cast("string")).alias("oid"), F.col("event_type").alias("source_key"), F.concat(F.lit("s"), (i % 3).cast("string")).alias("sid")
    )
    return episodes.attribution(episodes.detect(m), grants)


@query(f"WITH {ATTRIBUTION} SELECT * FROM attr")
def episode_attribution(spark, sf_dir):
    return _attribution(spark, sf_dir)


@query(f"WITH {ATTRIBUTION} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, denial_event_id, dimension ORDER BY granted_bytes DESC, key) AS INTEGER) AS rank FROM attr) WHERE rank <= 5")
def attribution_top5(spark, sf_dir):
    return episodes.top_attribution(_attribution(spark, sf_dir))


@query("SELECT event_id, CASE WHEN value >= 40 THEN 'critical' WHEN value >= 20 THEN 'warn' ELSE 'info' END AS used, CASE WHEN value <= 5 THEN 'critical' WHEN value <= 20 THEN 'warn' ELSE 'info' END AS headroom FROM events")
def threshold_flags(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", episodes.grade(value, 20, 40).alias("used"), episodes.grade(value, 20, 5, lower_is_worse=True).alias("headroom"))


TREND = """SELECT {by}, counter, arg_max(value, row(ts, event_id)) AS last_value, arg_max(event_id, row(ts, event_id)) AS last_event_id, arg_min(value, row(ts, event_id)) AS first_value, max(value) AS peak,
  arg_min(event_id, row(-value, ts, event_id)) AS peak_event_id, count(value) AS sample_count, CAST(0 AS BIGINT) AS excluded_samples"""


@query(
    f"""WITH s AS (SELECT user_id AS case_id, event_type AS counter, ts, event_id, CAST(value AS DECIMAL(18,2)) AS value FROM events), t AS ({TREND.format(by="case_id")},
  (arg_max(value, row(ts, event_id)) - arg_min(value, row(ts, event_id))) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS slope FROM s GROUP BY ALL)
  SELECT * EXCLUDE (slope), round(CAST(slope AS DECIMAL(38,12)), 4) AS slope_per_second FROM t"""
)
def counter_trend(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("counter"), "ts", "event_id", F.col("value").cast("decimal(18,2)").alias("value"))
    return episodes.counter_trends(s, ["case_id"]).withColumn("slope_per_second", F.round(F.col("slope_per_second").cast("decimal(38,12)"), 4))


SPANS = """spans AS (SELECT case_id, denial_event_id AS span_id, denial_ts - INTERVAL 6 HOUR AS start_ts, denial_ts AS end_ts FROM episodes_c),
v AS (SELECT user_id AS case_id, ts, event_id, value FROM events WHERE event_type = 'view'),
cor AS (SELECT s.*, v.event_id, v.value FROM spans s LEFT JOIN v ON v.case_id = s.case_id AND v.ts BETWEEN start_ts AND end_ts)"""


def _correlated(spark, sf_dir) -> DataFrame:
    found = episodes.detect(markers(spark, sf_dir))
    spans = found.select("case_id", F.col("denial_event_id").alias("span_id"), (F.col("denial_ts") - F.expr("interval 6 hours")).alias("start_ts"), F.col("denial_ts").alias("end_ts"))
    samples = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("case_id"), "ts", "event_id", "value")
    return episodes.correlate(spans, samples)


@query(f"WITH {EPISODES}, {SPANS} SELECT case_id, span_id, count(event_id) AS samples, max(CAST(value AS DECIMAL(18,2))) AS peak FROM cor GROUP BY 1, 2")
def episode_counter_correlation(spark, sf_dir):
    return _correlated(spark, sf_dir).groupBy("case_id", "span_id").agg(F.count("event_id").alias("samples"), F.max(F.col("value").cast("decimal(18,2)")).alias("peak"))


@query(f"WITH {EPISODES}, {SPANS} SELECT case_id, span_id, 'no-overlap' AS dimension, 'critical' AS severity FROM cor GROUP BY 1, 2 HAVING count(event_id) = 0")
def hazard_non_overlap(spark, sf_dir):
    counts = _correlated(spark, sf_dir).groupBy("case_id", "span_id").agg(F.count("event_id").alias("n")).where("n = 0")
    return counts.select("case_id", "span_id", F.lit("no-overlap").alias("dimension"), F.lit("critical").alias("severity"))


@query("SELECT user_id AS case_id, event_type AS counter, 'warn' AS severity FROM events GROUP BY 1, 2 HAVING bool_and(floor(value / 60) = 0)")
def hazard_zero_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("counter")).agg(F.bool_and(F.floor(F.col("value") / 60) == 0).alias("zero")).where("zero")
    return e.select("case_id", "counter", F.lit("warn").alias("severity"))


def threads(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("frames"))
    return c.select(F.lit("case").alias("case_id"), F.concat(F.lit("dump"), (F.col("conv_id") % 3).cast("string")).alias("dump"), F.col("conv_id").alias("thread"), "frames")


#: Stand-in rules for the roles of conversations.
RULES = [stacks.Rule("running", "tools", "exact", "tool"), stacks.Rule("blocked-on-lock", "lock", "prefix", "sys"), stacks.Rule("blocked-on-external", "model", "contains", "assist"), stacks.Rule("idle-parked", "people", "exact", "user")]
SIGNATURES = """th AS (SELECT conv_id, 'dump' || CAST(conv_id % 3 AS VARCHAR) AS dump, list(role ORDER BY turn) AS frames FROM conversations GROUP BY 1, 2),
sig AS (SELECT 'case' AS case_id, dump, frames, count(*) AS thread_count FROM th GROUP BY ALL),
cls AS (SELECT *, CASE WHEN list_contains(frames, 'tool') THEN 'running' WHEN len(list_filter(frames, lambda x: starts_with(x, 'sys'))) > 0 THEN 'blocked-on-lock' WHEN len(list_filter(frames, lambda x: contains(x, 'assist'))) > 0 THEN 'blocked-on-external'
  WHEN list_contains(frames, 'user') THEN 'idle-parked' ELSE 'unclassified' END AS role FROM sig),
cl AS (SELECT *, CASE role WHEN 'running' THEN 'tools' WHEN 'blocked-on-lock' THEN 'lock' WHEN 'blocked-on-external' THEN 'model' WHEN 'idle-parked' THEN 'people' END AS subsystem FROM cls)"""


def _classified(spark, sf_dir) -> DataFrame:
    return stacks.classify(stacks.signatures(threads(spark, sf_dir)), RULES)


@query(f"WITH {SIGNATURES} SELECT * FROM sig")
def stack_signatures(spark, sf_dir):
    return stacks.signatures(threads(spark, sf_dir))


@query(f"WITH {SIGNATURES} SELECT case_id, dump, frames, thread_count, role, subsystem FROM cl")
def classify_signatures(spark, sf_dir):
    return _classified(spark, sf_dir).select("case_id", "dump", "frames", "thread_count", "role", "subsystem")


@query(
    f"""WITH {SIGNATURES}, r AS (SELECT unnest(['running', 'blocked-on-lock', 'blocked-on-external', 'idle-parked', 'unclassified']) AS role)
SELECT d.case_id, d.dump, r.role, CAST(coalesce(sum(thread_count), 0) AS BIGINT) AS threads, count(cl.frames) AS signatures FROM (SELECT DISTINCT case_id, dump FROM cl) d CROSS JOIN r LEFT JOIN cl ON cl.dump = d.dump AND cl.role = r.role GROUP BY 1, 2, 3"""
)
def role_partition_zero_filled(spark, sf_dir):
    return stacks.role_partition(_classified(spark, sf_dir))


@query(
    f"""WITH {SIGNATURES}, p AS (SELECT case_id, dump, subsystem, CAST(sum(thread_count) AS BIGINT) AS total, CAST(sum(CASE WHEN role = 'idle-parked' THEN thread_count ELSE 0 END) AS BIGINT) AS idle, count(*) AS signature_count FROM cl GROUP BY 1, 2, 3)
SELECT case_id, dump, subsystem, total, idle, total - idle AS busy, CAST(round(1 - CAST(idle AS DOUBLE) / total, 4) AS DECIMAL(10,4)) AS occupancy, signature_count FROM p"""
)
def pool_occupancy(spark, sf_dir):
    return stacks.pools(_classified(spark, sf_dir))


@query(f"WITH {SIGNATURES} SELECT case_id, dump, subsystem, CAST(sum(thread_count) AS BIGINT) AS threads, count(*) AS signature_count FROM cl WHERE role = 'blocked-on-external' GROUP BY 1, 2, 3")
def dependency_waits(spark, sf_dir):
    return stacks.dependency_waits(_classified(spark, sf_dir))


@query(f"WITH {SIGNATURES} SELECT case_id, dump, '(no application frame)' AS site, CAST(sum(thread_count) AS BIGINT) AS threads, count(*) AS signature_count FROM cl WHERE role = 'blocked-on-lock' GROUP BY 1, 2")
def lock_sites(spark, sf_dir):
    return stacks.lock_sites(_classified(spark, sf_dir))


@query("SELECT user_id % 5 AS case_id, 'u' || CAST(user_id AS VARCHAR) AS dump, min(ts) AS ts, CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY min(ts), 'u' || CAST(user_id AS VARCHAR)) - 1 AS INTEGER) AS dump_idx, false AS order_by_name FROM events GROUP BY user_id")
def dump_order(spark, sf_dir):
    dumps = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("ts")).select((F.col("user_id") % 5).alias("case_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dump"), "ts")
    return stacks.dump_order(dumps)


@query(
    f"""WITH {SIGNATURES}, f AS (SELECT DISTINCT frames FROM sig), k AS (SELECT f.frames, list(coalesce(thread_count, 0) ORDER BY d.dump) AS counts FROM f CROSS JOIN (SELECT DISTINCT dump FROM sig) d LEFT JOIN sig ON sig.frames = f.frames AND sig.dump = d.dump GROUP BY 1)
SELECT 'case' AS case_id, frames, counts, [counts[2] - counts[1], counts[3] - counts[2]] AS step_deltas, counts[3] - counts[1] AS overall_delta, counts[1] = 0 AND counts[3] > 0 AS appeared, counts[1] > 0 AND counts[3] = 0 AS vanished FROM k"""
)
def progression(spark, sf_dir):
    rows = stacks.signatures(threads(spark, sf_dir))
    order = stacks.dump_order(rows.select("case_id", "dump").distinct().withColumn("ts", F.lit(None).cast("timestamp")))
    return stacks.progression(rows, order)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_verdict(spark, sf_dir):
    return ev.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_orderstatus AS level, count(*) AS total, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS ruled FROM orders GROUP BY 1")
def review_progress(spark, sf_dir):
    ruled = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("ruled", F.lit(1))
    o = table(spark, sf_dir, "orders")
    return o.join(ruled, o.o_orderkey == F.col("k"), "left").groupBy(F.col("o_orderstatus").alias("level")).agg(F.count(F.lit(1)).alias("total"), F.count("ruled").alias("ruled"))


@query(f"WITH {EVENTS} SELECT n.case_id, n.event_id, n.severity FROM events_c n WHERE NOT EXISTS (SELECT 1 FROM events_c o WHERE o.source IN ('view', 'click') AND o.event_id = n.event_id AND o.case_id = n.case_id)")
def idempotent_insert(spark, sf_dir):
    e = canonical(spark, sf_dir)
    return ev.new_events(e.where("source in ('view', 'click')"), e.unionByName(e)).select("case_id", "event_id", "severity")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_by_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return ev.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT user_id, list_has_all(list(DISTINCT event_id) FILTER (WHERE event_type <> 'error'), list(DISTINCT event_id) FILTER (WHERE value > 60)) AS citations_valid FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 60) > 0")
def citation_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("prompted"), F.collect_set(F.when(F.col("value") > 60, F.col("event_id"))).alias("cited")).where("size(cited) > 0")
    return e.select("user_id", (F.size(F.array_except("cited", "prompted")) == 0).alias("citations_valid"))


@query(
    """WITH e AS (SELECT doc_id, lang, text, greatest(1, length(text) // 4) AS est FROM documents), s AS (SELECT lang, sum(est) AS total, count(*) AS n FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN total > 20000 THEN left(text, CAST(greatest(1, 20000 // n) * 4 AS BIGINT)) ELSE text END AS excerpt FROM e JOIN s USING (lang)"""
)
def prompt_budget_fit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("est", T.token_estimate(F.col("text")))
    share = d.groupBy("lang").agg(F.sum("est").alias("total"), F.count(F.lit(1)).alias("n"))
    rows = d.join(F.broadcast(share), "lang")  # one row a language
    return rows.select("doc_id", F.when(F.col("total") > 20000, F.expr("substring(text, 1, int(greatest(1, 20000 div n) * 4))")).otherwise(F.col("text")).alias("excerpt"))


def _first_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(CAST(sqrt(list_sum(list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS DECIMAL(38,12)), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10"
)
def knn_topk(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)
    return found.select("vec_id", F.round(F.col("distance").cast("decimal(38,12)"), 6).alias("distance"))


@query("SELECT CAST(pos - 1 AS INTEGER) AS pos, round(CAST(avg(x) AS DECIMAL(38,12)), 6) AS mean FROM (SELECT unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def mean_query_vector(spark, sf_dir):
    return vectors.mean_vector(table(spark, sf_dir, "embeddings")).select(F.posexplode("embedding").alias("pos", "x")).select("pos", F.round(F.col("x").cast("decimal(38,12)"), 6).alias("mean"))


@query("SELECT vec_id, round(CAST(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS DECIMAL(38,12)), 6) AS l1 FROM embeddings")
def l2_normalise(spark, sf_dir):
    unit = vectors.l2_normalise(table(spark, sf_dir, "embeddings"))
    return unit.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)).cast("decimal(38,12)"), 6).alias("l1"))


@query()
def cluster_hdbscan(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")))
    return vectors.cluster(e, "hdbscan")


@query()
def cluster_agglomerative(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("case_id", F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")))
    return vectors.cluster(e, "agglomerative")


@query("SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)) AS reused, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)) AS fresh FROM documents d")
def embed_reuse_split(spark, sf_dir):
    d, known = table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "benchmark").select("text").distinct()
    split = d.join(known, "text", "left_semi").withColumn("reused", F.lit(1)).unionByName(d.join(known, "text", "left_anti").withColumn("reused", F.lit(0)))
    return split.agg(F.coalesce(F.sum("reused"), F.lit(0)).alias("reused"), F.coalesce(F.sum(1 - F.col("reused")), F.lit(0)).alias("fresh"))


@query("SELECT CAST(avg(quality) AS DECIMAL(18,6)) AS quality_rate, CAST(coalesce(avg(CASE WHEN quality = 1 THEN 1 - toxic END), 1) AS DECIMAL(18,6)) AS clean_rate, avg(quality) >= 0.8 AND coalesce(avg(CASE WHEN quality = 1 THEN 1 - toxic END), 1) >= 0.8 AS passed FROM labels")
def eval_gate(spark, sf_dir):
    clean = F.coalesce(F.avg(F.when(F.col("quality") == 1, 1 - F.col("toxic"))), F.lit(1.0))
    rates = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("q"), clean.alias("c"))
    return rates.select(F.col("q").cast("decimal(18,6)").alias("quality_rate"), F.col("c").cast("decimal(18,6)").alias("clean_rate"), ((F.col("q") >= 0.8) & (F.col("c") >= 0.8)).alias("passed"))


@query("SELECT source, sum(strlen(text))::BIGINT AS total_bytes, sum(CASE WHEN lang <> 'en' THEN strlen(text) ELSE 0 END)::BIGINT AS unknown_bytes, CAST(round(1 - CAST(sum(CASE WHEN lang <> 'en' THEN strlen(text) ELSE 0 END) AS DOUBLE) / sum(strlen(text)), 6) AS DECIMAL(18,6)) AS coverage FROM documents GROUP BY 1")
def parse_coverage(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(size).alias("total_bytes"), F.sum(F.when(F.col("lang") != "en", size).otherwise(F.lit(0).cast("long"))).alias("unknown_bytes"))
    return d.withColumn("coverage", F.round(F.coalesce(1 - F.try_divide("unknown_bytes", "total_bytes"), F.lit(1.0)), 6).cast("decimal(18,6)"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 8 <= 2 THEN 'fatal' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 8 = 3 THEN 'error' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 8 = 4 THEN 'warn' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 8 <= 6 THEN 'info' ELSE 'debug' END AS severity FROM events")
def journal_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), T.priority_severity(k % 8).alias("severity"))


@query("SELECT n_name AS nation, c_mktsegment AS segment, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def dim_rollup(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.rollup(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'only_orders', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def set_ops(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_orders"))


@query(f"WITH {EVENTS} SELECT event_id, ts FROM events_c ORDER BY ts, source_file, line_start, event_id LIMIT 200 OFFSET 200")
def keyset_page(spark, sf_dir):
    e = canonical(spark, sf_dir)
    last = ev.page_after(e, None).agg(F.max(F.struct("ts", "source_file", "line_start", "event_id")).alias("k")).first()
    return ev.page_after(e, last.k.asDict() if last.k else None).select("event_id", "ts")
