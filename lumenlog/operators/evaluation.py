"""Evaluation against known truth: metrics of cases, means of a suite, and the gate over floors and conditions."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics with a floor, ranks that count for a hit.
METRICS = ("retrieval_hit_rate", "hypothesis_hit_at_k", "citation_validity_rate", "determinism_stability", "eustack_detection_rate")
K = 3
CASES = "name string, retrieval_hit_rate double, hypothesis_hit_at_k double, citation_validity_rate double, determinism_stability double, expect_no_incident boolean, negative_case_pass boolean, run_failed boolean, is_eustack boolean, eustack_case_pass boolean"


@dataclass(frozen=True)
class ExpectStacks:
    provenance: str
    hang_detected: bool
    total_threads: int
    warn: int = 0
    critical: int = 0
    info_dimensions: list[str] = field(default_factory=list)
    pools: dict[str, int] = field(default_factory=dict)
    dependencies: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Truth:
    root_cause: str
    required_evidence: list[str] = field(default_factory=list)
    acceptable_keywords: list[str] = field(default_factory=list)
    expect_no_incident: bool = False
    expect_eustack: ExpectStacks | None = None


def read_truth(path: str) -> Truth:
    """A truth file: YAML by the safe loader where that is installed, else the JSON subset; unknown keys are errors."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except ModuleNotFoundError:
        data = json.loads(text)
    try:
        expected = (data or {}).pop("expect_eustack", None)
        return Truth(**data, expect_eustack=ExpectStacks(**expected) if expected else None)
    except (TypeError, AttributeError) as e:
        raise ValueError(f"invalid truth file {path}: {e}") from e


def read_floors(path: str) -> dict[str, float]:
    """The floors of a TOML file, one for each metric; a missing or non-numeric one is an error."""
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        return {m: float(raw[m]) for m in METRICS}
    except (OSError, tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
        raise ValueError(f"invalid thresholds file {path}: {e}") from e


def exemplar_texts(scored: DataFrame, groups: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """(case_id, text): the first exemplars' messages of the groups of the n top clusters."""
    members = scored.where(F.col("rank") <= n).select("case_id", F.explode("template_ids").alias("template_id"))
    ids = members.join(groups, ["case_id", "template_id"]).select("case_id", F.get("exemplar_event_ids", F.lit(0)).alias("event_id")).where("event_id is not null")
    return ids.join(events.select("case_id", "event_id", F.col("message").alias("text")), ["case_id", "event_id"]).select("case_id", "text")


def retrieval_hit_rate(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(case_id, retrieval_hit_rate): the share of a case's patterns that some text has, in any case; 1 without patterns.

    patterns: (case_id, pattern) with a null pattern for a case without any. Texts are matched one by one, not as one document.
    """
    found = patterns.where("pattern is not null").join(texts, "case_id").groupBy("case_id", "pattern").agg(F.max(F.regexp_like("text", F.concat(F.lit("(?im)"), F.col("pattern")))).alias("hit"))
    rows = patterns.join(found, ["case_id", "pattern"], "left")
    return rows.groupBy("case_id").agg(F.coalesce(F.avg(F.when(F.col("pattern").isNotNull(), F.coalesce("hit", F.lit(False)).cast("double"))), F.lit(1.0)).alias("retrieval_hit_rate"))


def hit_at_k(hypotheses: DataFrame, keywords: DataFrame, k: int = K) -> DataFrame:
    """(case_id, hypothesis_hit_at_k): 1 if title or narrative of one of the first k hypotheses has a keyword, in any case; 0 without keywords."""
    top = hypotheses.where(F.col("hyp_index") < k).select("case_id", F.lower(F.concat_ws("\n", "title", "narrative")).alias("text"))
    hits = keywords.where("keyword is not null").join(top, "case_id").where(F.contains(F.col("text"), F.lower("keyword"))).select("case_id").distinct().withColumn("hit", F.lit(1.0))
    return keywords.select("case_id").distinct().join(hits, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0.0)).alias("hypothesis_hit_at_k"))


def _rate(flag: Column) -> Column:
    return F.coalesce(F.avg(flag.cast("double")), F.lit(1.0))


def citation_validity(hypotheses: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, citation_validity_rate): the share of valid hypotheses; 1 for a case without any."""
    return cases.select("case_id").distinct().join(hypotheses.select("case_id", "citations_valid"), "case_id", "left").groupBy("case_id").agg(_rate(F.col("citations_valid")).alias("citation_validity_rate"))


def determinism(documents: DataFrame) -> DataFrame:
    """(case_id, determinism_stability): 1 if all of a case's documents are equal."""
    return documents.groupBy("case_id").agg(F.when(F.count_distinct("document") <= 1, 1.0).otherwise(0.0).alias("determinism_stability"))


def negative_pass(hypotheses: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, negative_case_pass): no hypothesis, or none but low ones."""
    return cases.select("case_id").distinct().join(hypotheses.select("case_id", "confidence"), "case_id", "left").groupBy("case_id").agg(F.coalesce(F.bool_and(F.col("confidence") == "low"), F.lit(True)).alias("negative_case_pass"))


def stack_verdict(stacks: dict[str, DataFrame], expect: DataFrame) -> DataFrame:
    """(case_id, eustack_case_pass): whether the latest dump has all expected figures.

    expect: (case_id, kind, key, value) with kind threads, pool (busy threads), dependency (threads), severity (flags of a level) or info (a
    dimension at level info); a figure that is missing differs. The info dimensions must be all there are.
    """
    latest = {k: v.where("latest") for k, v in stacks.items() if k in ("signatures", "pools", "dependencies", "flags")}
    flags = latest["flags"]
    parts = [
        latest["signatures"].groupBy("case_id").agg(F.sum("thread_count").alias("n")).select("case_id", F.lit("threads").alias("kind"), F.lit("").alias("key"), "n"),
        latest["pools"].select("case_id", F.lit("pool").alias("kind"), F.col("subsystem").alias("key"), F.col("busy").alias("n")),
        latest["dependencies"].select("case_id", F.lit("dependency").alias("kind"), F.col("subsystem").alias("key"), F.col("threads").alias("n")),
        flags.groupBy("case_id", F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit("severity").alias("kind"), "key", "n"),
        flags.where("severity = 'info'").select("case_id", F.lit("info").alias("kind"), F.col("dimension").alias("key"), F.lit(1).cast("long").alias("n")).distinct(),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    own = expect.join(found, ["case_id", "kind", "key"], "left")
    # A level of which there are no flags has no row: its figure is zero.
    figure = F.when(F.col("kind") == "severity", F.coalesce("n", F.lit(0))).otherwise(F.col("n"))
    judged = own.groupBy("case_id").agg(F.bool_and(F.coalesce(figure == F.col("value"), F.lit(False))).alias("ok"))
    extra = found.where("kind = 'info'").join(expect, ["case_id", "kind", "key"], "left_anti").select("case_id").distinct().withColumn("extra", F.lit(True))
    return judged.join(extra, "case_id", "left").select("case_id", (F.col("ok") & F.col("extra").isNull()).alias("eustack_case_pass"))


def expected_figures(case_id: str, expect: ExpectStacks) -> list[tuple[str, str, str, int]]:
    rows = [("threads", "", expect.total_threads), ("severity", "warn", expect.warn), ("severity", "critical", expect.critical)]
    rows += [("pool", k, v) for k, v in expect.pools.items()] + [("dependency", k, v) for k, v in expect.dependencies.items()] + [("info", d, 1) for d in expect.info_dimensions]
    return [(case_id, *r) for r in rows]


def suite_means(cases: DataFrame) -> DataFrame:
    """One row with the mean of each metric over the cases that it counts for; 1 where there are none."""
    run = ~F.col("run_failed")
    scored = run & ~F.col("is_eustack")
    positive = scored & ~F.col("expect_no_incident")
    stacks = run & F.col("is_eustack")
    mean = lambda when, column: F.coalesce(F.avg(F.when(when, column)), F.lit(1.0))
    return cases.agg(
        mean(positive, F.col("retrieval_hit_rate")).alias(METRICS[0]), mean(positive, F.col("hypothesis_hit_at_k")).alias(METRICS[1]), mean(scored, F.col("citation_validity_rate")).alias(METRICS[2]), mean(scored, F.col("determinism_stability")).alias(METRICS[3]),
        mean(stacks, F.coalesce(F.col("eustack_case_pass"), F.lit(False)).cast("double")).alias(METRICS[4]),
        F.count_if("run_failed").alias("failed"), F.count_if(run & F.col("expect_no_incident") & ~F.coalesce(F.col("negative_case_pass"), F.lit(True))).alias("false_positives"),
        F.count_if(run & ~F.col("expect_no_incident")).alias("positives"), F.count_if(stacks).alias("stacks"),
    )


def gate(means: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(name, value, floor, passed) of each metric and, as `gate`, of the whole: all floors, no failed case, no false positive, and cases of either kind."""
    metrics = F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).alias("value"), F.lit(float(floors[m])).alias("floor"), (F.col(m) >= F.lit(float(floors[m]))).alias("passed")) for m in METRICS])
    conditions = (F.col("failed") == 0) & (F.col("false_positives") == 0) & (F.col("positives") > 0) & (F.col("stacks") > 0)
    whole = F.struct(F.lit("gate").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("floor"), (F.forall(metrics, lambda m: m["passed"]) & conditions).alias("passed"))
    return means.select(F.explode(F.concat(metrics, F.array(whole))).alias("m")).select("m.*")
