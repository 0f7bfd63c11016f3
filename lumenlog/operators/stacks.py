"""Stack signatures: classification by rules, pools, lock sites and progression over snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import enclosing_frame, resolvable

ROLES = ("running", "blocked-on-lock", "blocked-on-external", "idle-parked", "unclassified")


@dataclass(frozen=True)
class Rule:
    role: str
    subsystem: str
    match: str  # exact, prefix or contains
    pattern: str

    def test(self, frame: Column) -> Column:
        if self.match == "exact":
            return frame == self.pattern
        return frame.startswith(self.pattern) if self.match == "prefix" else frame.contains(self.pattern)


def signatures(threads: DataFrame) -> DataFrame:
    """Threads (case_id, dump, thread, frames) by distinct stack."""
    return threads.groupBy("case_id", "dump", "frames").agg(F.count(F.lit(1)).alias("thread_count"))


def classify(signature_rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Role, subsystem, pattern, frame index and reason of each signature; the first rule that matches any resolvable frame wins.

    Distinct stacks are classified once and joined back; the rules are one CASE chain, so no join is needed for them.
    """

    def hits(rule: Rule):
        return lambda f: resolvable(f) & rule.test(f)

    chain = None
    for n, rule in enumerate(rules):
        value = F.struct(F.lit(rule.role).alias("role"), F.lit(rule.subsystem).alias("subsystem"), F.lit(rule.pattern).alias("pattern"), (F.array_position(F.transform("frames", hits(rule)), True) - 1).cast("int").alias("frame_index"), F.lit("matched").alias("reason"))
        test = F.exists("frames", hits(rule))
        chain = F.when(test, value) if n == 0 else chain.when(test, value)
    none = F.lit(None).cast("string")
    rest = F.struct(F.lit("unclassified").alias("role"), none.alias("subsystem"), none.alias("pattern"), F.lit(None).cast("int").alias("frame_index"), F.when(F.exists("frames", resolvable), "matched-no-rule").otherwise("no-resolvable-frame").alias("reason"))
    chain = rest if chain is None else chain.otherwise(rest)
    known = signature_rows.select("frames").distinct().select("frames", chain.alias("c")).select("frames", "c.*")
    return signature_rows.join(known, "frames")


def role_partition(classified: DataFrame) -> DataFrame:
    """Threads and signatures of every role in every dump, zero where there are none."""
    spark = classified.sparkSession
    roles = F.broadcast(spark.createDataFrame([(r,) for r in ROLES], "role string"))
    found = classified.groupBy("case_id", "dump", "role").agg(F.sum("thread_count").alias("threads"), F.count(F.lit(1)).alias("signatures"))
    every = classified.select("case_id", "dump").distinct().crossJoin(roles)
    zero = F.lit(0).cast("long")
    return every.join(found, ["case_id", "dump", "role"], "left").select("case_id", "dump", "role", F.coalesce("threads", zero).alias("threads"), F.coalesce("signatures", zero).alias("signatures"))


def pools(classified: DataFrame) -> DataFrame:
    """Occupancy of each subsystem; the unclassified ones are a pool of their own."""
    idle = F.sum(F.when(F.col("role") == "idle-parked", F.col("thread_count")).otherwise(0))
    out = classified.groupBy("case_id", "dump", "subsystem").agg(F.sum("thread_count").alias("total"), idle.alias("idle"), F.count(F.lit(1)).alias("signature_count"))
    share = F.round(F.lit(1).cast("decimal(20,10)") - F.col("idle").cast("decimal(20,0)") / F.col("total").cast("decimal(20,0)"), 4).cast("decimal(10,4)")
    return out.select("case_id", "dump", "subsystem", "total", "idle", (F.col("total") - F.col("idle")).alias("busy"), share.alias("occupancy"), "signature_count")


def lock_sites(classified: DataFrame, unknown: str = "(no application frame)") -> DataFrame:
    """Threads that wait for a lock, by the application frame around the wait."""
    waiting = classified.where(F.col("role") == "blocked-on-lock").withColumn("site", F.coalesce(enclosing_frame(F.col("frames"), F.col("frame_index")), F.lit(unknown)))
    return waiting.groupBy("case_id", "dump", "site").agg(F.sum("thread_count").alias("threads"), F.count(F.lit(1)).alias("signature_count"))


def dependency_waits(classified: DataFrame) -> DataFrame:
    waiting = classified.where(F.col("role") == "blocked-on-external")
    return waiting.groupBy("case_id", "dump", "subsystem").agg(F.sum("thread_count").alias("threads"), F.count(F.lit(1)).alias("signature_count"))


def dump_order(dumps: DataFrame) -> DataFrame:
    """Position of each dump (case_id, dump, ts) in its case: by time if all have one, else by name with a warning flag."""
    case = Window.partitionBy("case_id")
    timed = F.bool_and(F.col("ts").isNotNull()).over(case)
    rows = dumps.withColumn("timed", timed)
    order = Window.partitionBy("case_id").orderBy(F.when(F.col("timed"), F.col("ts")), "dump")
    return rows.select("case_id", "dump", "ts", (F.row_number().over(order) - 1).alias("dump_idx"), (~F.col("timed")).alias("order_by_name"))


def progression(signature_rows: DataFrame, order: DataFrame) -> DataFrame:
    """Thread counts of each stack in every dump of its case, with the changes between dumps; zero where it is absent."""
    counts = signature_rows.join(order.select("case_id", "dump", "dump_idx"), ["case_id", "dump"])
    found = counts.groupBy("case_id", "frames").agg(F.map_from_entries(F.collect_list(F.struct("dump_idx", "thread_count"))).alias("by"))
    last = order.groupBy("case_id").agg(F.max("dump_idx").alias("last"))
    series = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long")))
    out = found.join(last, "case_id").withColumn("counts", series)
    size = F.size("counts")
    steps = F.when(size > 1, F.zip_with(F.slice("counts", F.lit(2), F.greatest(size - 1, F.lit(1))), F.slice("counts", F.lit(1), F.greatest(size - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array().cast("array<bigint>"))
    first, end = F.element_at("counts", 1), F.element_at("counts", -1)
    return out.select("case_id", "frames", "counts", steps.alias("step_deltas"), (end - first).alias("overall_delta"), ((first == 0) & (end > 0)).alias("appeared"), ((first > 0) & (end == 0)).alias("vanished"))


# Rules files, saturation flags and bundles of dumps.

MATCHES = {"exact", "prefix", "contains"}
#: Cut points of the saturation flags, event ids cited by an aggregate, and how dumps were ordered.
SATURATION = {"unclassified_thread_pct": (5.0, 15.0), "no_resolvable_frame_pct": (5.0, 15.0), "lock_convergence_count": (5.0, 20.0)}
EXEMPLARS = 3
ORDERED_BY = ("single", "timestamp", "filename")
UNORDERED = "ordering_unverified"


def read_rules(path: str) -> tuple[list[Rule], str]:
    """The rules of a TOML file, in file order, which is their precedence, and a hash of its text.

    Unknown keys, empty patterns, patterns that are not normalised and repeated (match, pattern) pairs are errors; so is a missing file.
    """
    from hashlib import sha256
    from pathlib import Path

    text = Path(path).read_text(encoding="utf-8")
    return parse_rules(text), sha256(text.encode()).hexdigest()[:16]


def parse_rules(text: str) -> list[Rule]:
    import tomllib

    spec = tomllib.loads(text)
    meta = spec.get("meta", {})
    if set(spec) - {"meta", "rule"} or set(meta) != {"version", "validated_against"}:
        raise ValueError("a rules file has [meta] with version and validated_against, and [[rule]] tables")
    out, seen = [], set()
    for n, given in enumerate(spec.get("rule", []), 1):
        rule = {"match": "exact"} | given
        if set(rule) != {"role", "subsystem", "match", "pattern"} or rule["role"] not in ROLES[:-1] or rule["match"] not in MATCHES:
            raise ValueError(f"rule {n}: wrong keys, role or match")
        pattern = rule["pattern"]
        if not pattern.strip() or pattern != pattern.split(" - ")[0].strip().split("@")[0].strip():
            raise ValueError(f"rule {n}: the pattern is empty or not normalised: {pattern!r}")
        if (rule["match"], pattern) in seen:
            raise ValueError(f"rule {n}: repeated {rule['match']} {pattern!r}")
        seen.add((rule["match"], pattern))
        out.append(Rule(rule["role"], rule["subsystem"], rule["match"], pattern))
    return out


def threads_of(events: DataFrame) -> DataFrame:
    """(case_id, dump, thread, frames, event_id, ts, ts_confidence) of thread records; a file is a dump."""
    from ..functions.text import frames_of

    rows = events.where((F.col("source") == "eustack") & F.col("thread").isNotNull())
    return rows.select("case_id", F.col("source_file").alias("dump"), "thread", frames_of(F.col("raw")).alias("frames"), "event_id", "ts", "ts_confidence")


def dumps_of(events: DataFrame) -> DataFrame:
    """(case_id, dump, ts, ts_confidence, thread_count): each dump has the time of its first thread record; none without threads."""
    rows = events.where(F.col("source") == "eustack")
    is_thread = F.col("thread").isNotNull()
    first = F.min_by(F.struct("ts", "ts_confidence"), F.when(is_thread, F.struct("line_start", "event_id")))
    out = rows.groupBy("case_id", F.col("source_file").alias("dump")).agg(first.alias("first"), F.count_if(is_thread).alias("thread_count"))
    return out.select("case_id", "dump", "first.ts", F.coalesce("first.ts_confidence", F.lit("missing")).alias("ts_confidence"), "thread_count")


def order_basis(order: DataFrame) -> DataFrame:
    """(case_id, basis, flag) of dump_order's result: how the dumps of each case were ordered, and a warning if by name."""
    size = F.count(F.lit(1))
    basis = F.when(size <= 1, ORDERED_BY[0]).when(F.bool_or("order_by_name"), ORDERED_BY[2]).otherwise(ORDERED_BY[1])
    out = order.groupBy("case_id").agg(basis.alias("basis"))
    return out.withColumn("flag", F.when(F.col("basis") == ORDERED_BY[2], UNORDERED))


def saturation_flags(classified: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Graded flags of each dump: the shares of threads without a role and without a resolvable frame, and each lock site's threads.

    The shares are given wherever there are threads. Occupancy is never graded.
    """
    from .episodes import grade

    cut = SATURATION | (thresholds or {})
    loose = F.col("role") == "unclassified"
    threads = lambda when: F.sum(F.when(when, F.col("thread_count")).otherwise(0))
    shares = classified.groupBy("case_id", "dump").agg(F.sum("thread_count").alias("all"), threads(loose).alias("a"), threads(loose & (F.col("reason") == "no-resolvable-frame")).alias("b"))
    said = {"unclassified_thread_pct": ("a", "% of threads are unclassified."), "no_resolvable_frame_pct": ("b", "% of threads have no resolvable frame.")}
    none, unit = F.lit(None).cast("string"), F.lit("percent")
    rows = []
    for n, (dimension, (column, text)) in enumerate(said.items()):
        value = F.round(F.col(column) / F.col("all") * 100, 1)
        rows.append(F.struct(F.lit(n).alias("position"), F.lit(dimension).alias("dimension"), grade(value, *cut[dimension]).alias("severity"), value.alias("value"), unit.alias("unit"), none.alias("site"), F.concat(value.cast("string"), F.lit(text)).alias("message")))
    out = shares.where("all > 0").select("case_id", "dump", F.explode(F.array(*rows)).alias("f")).select("case_id", "dump", "f.*")
    dimension = "lock_convergence_count"
    value = F.col("threads").cast("double")
    message = F.concat(F.col("threads").cast("string"), F.lit(" threads are converging on the lock site "), F.col("site"), F.lit("."))
    place = F.row_number().over(Window.partitionBy("case_id", "dump").orderBy(F.desc("threads"), "site")) + 1
    sites = lock_sites(classified).select("case_id", "dump", place.alias("position"), F.lit(dimension).alias("dimension"), grade(value, *cut[dimension]).alias("severity"), value.alias("value"), F.lit("threads").alias("unit"), "site", message.alias("message"))
    return out.unionByName(sites)


def changed(progressed: DataFrame) -> DataFrame:
    """Signatures whose count differs between any two dumps."""
    return progressed.where((F.col("overall_delta") != 0) | F.exists("step_deltas", lambda x: x != 0))


def changed_count(progressed: DataFrame) -> DataFrame:
    moved = (F.col("overall_delta") != 0) | F.exists("step_deltas", lambda x: x != 0)
    return progressed.groupBy("case_id").agg(F.count_if(moved).alias("changed"), F.count(F.lit(1)).alias("signatures"))


def last_seen(classified: DataFrame, order: DataFrame) -> DataFrame:
    """The classification of each signature in the latest dump that has it, with its matched and its leaf frame."""
    rows = classified.join(order.select("case_id", "dump", "dump_idx"), ["case_id", "dump"])
    best = rows.groupBy("case_id", "frames").agg(F.max_by(F.struct("role", "subsystem", "pattern", "frame_index", "reason"), "dump_idx").alias("c"))
    return best.select("case_id", "frames", "c.*", F.when(F.col("c.frame_index").isNotNull(), F.get("frames", F.col("c.frame_index"))).alias("matched_frame"), F.get("frames", F.lit(0)).alias("leaf_frame"))


def signature_exemplars(threads: DataFrame, k: int = EXEMPLARS) -> DataFrame:
    """(case_id, dump, frames, population, exemplars): the lowest event ids of each signature, a few from each task."""
    return exemplars_by(threads, ["case_id", "dump", "frames"], k)


def exemplars_by(rows: DataFrame, by: list[str], k: int = EXEMPLARS) -> DataFrame:
    """Population and the k lowest distinct event ids of each group."""
    distinct = rows.select(*by, "event_id").distinct()
    few = distinct.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("event_id"))).where(F.col("n") <= k)
    lowest = few.groupBy(*by).agg(F.sort_array(F.collect_list("event_id")).alias("exemplars"))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("population"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    same = keys[0]
    for key in keys[1:]:
        same = same & key
    return counts.alias("a").join(lowest.alias("b"), same).select(*(f"a.{c}" for c in by), "population", "exemplars")


def analyse(events: DataFrame, rules: list[Rule], thresholds: dict[str, tuple[float, float]] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda frame: frame) -> dict[str, DataFrame]:
    """All frames of the stack analysis: dumps, signatures, roles, pools, lock_sites, dependencies, flags, progression, threads.

    Pools, sites, dependencies and flags are those of every dump; `latest` marks the last one of its case, of which reports tell.
    keep is applied to what several frames share.
    """
    threads = keep(threads_of(events))
    dumps = keep(dumps_of(events))
    order = keep(dump_order(dumps.select("case_id", "dump", "ts")))
    sizes = order.groupBy("case_id").agg(F.max("dump_idx").alias("last"))
    placed = order.join(sizes, "case_id").withColumn("latest", F.col("dump_idx") == F.col("last"))
    classified = keep(classify(signatures(threads), rules))
    rows = progression(signatures(threads), order).join(last_seen(classified, order), ["case_id", "frames"])
    mark = placed.select("case_id", "dump", "dump_idx", "latest")
    marked = lambda df: df.join(mark, ["case_id", "dump"])
    return {
        "dumps": dumps.join(mark, ["case_id", "dump"]), "basis": order_basis(order), "threads": threads, "signatures": marked(classified), "roles": marked(role_partition(classified)), "pools": marked(pools(classified)),
        "lock_sites": marked(lock_sites(classified)), "dependencies": marked(dependency_waits(classified)), "flags": marked(saturation_flags(classified, thresholds)), "progression": rows,
    }


def report_order(kind: str) -> list[Column]:
    """The order of a frame's rows in reports."""
    return {
        "signatures": [F.desc("thread_count"), F.col("frames")], "pools": [F.desc("total"), F.col("subsystem").isNull(), F.col("subsystem")], "lock_sites": [F.desc("threads"), F.col("site")],
        "dependencies": [F.desc("threads"), F.col("subsystem")], "flags": [F.col("position")], "progression": [F.desc(F.abs("overall_delta")), F.desc(F.element_at("counts", -1)), F.col("frames")], "dumps": [F.col("dump_idx")], "roles": [F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))],
    }[kind]
