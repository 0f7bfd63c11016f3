"""Hypotheses: what a model is shown, what it may cite, and what becomes of its answer.

The model is any function from chat messages to text; without one nothing here touches a network. Everything that grows with the case
(ranking, exemplars, fact blocks) is DataFrame work; the prompt holds the top clusters only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate

Chat = Callable[[list[dict[str, str]]], str]
#: Clusters shown, the context without a known one, tokens kept for the answer, confidences.
TOP, CONTEXT, RESERVE = 12, 8192, 1024
CONFIDENCES = ("low", "medium", "high")
_TEXTS = ("title", "narrative", "confidence_reasoning")
_KEYS = {"title", "narrative", "confidence", "confidence_reasoning", "supporting_event_ids", "contradicting_evidence", "suggested_next_steps"}

PROMPT = """You are given log evidence of one incident. Each line begins with [evt:<id>].
Answer with one JSON object: {"hypotheses": [{"title", "narrative", "confidence" (low, medium or high), "confidence_reasoning",
"supporting_event_ids" (ids shown here only), "contradicting_evidence" (or null), "suggested_next_steps"}], "timeline_summary",
"unexplained_signals"}.
<<<KB
Reference material (not evidence, never cite it):
<<KB_CONTEXT>>
KB>>>
<<<MCM
<<MCM_FACTS>>
MCM>>>
<<<PERFMON
<<PERFMON_FACTS>>
PERFMON>>>
<<<EUSTACK
<<EUSTACK_FACTS>>
EUSTACK>>>
Evidence:
"""
SLOTS = {"KB": "<<KB_CONTEXT>>", "MCM": "<<MCM_FACTS>>", "PERFMON": "<<PERFMON_FACTS>>", "EUSTACK": "<<EUSTACK_FACTS>>"}


@dataclass
class Outcome:
    """What a run came to. failed: nothing to keep; degraded: kept, but not valid in full."""

    answer: dict | None
    prompt: str
    prompted: set[str]
    raw: str | None = None
    degraded: bool = False
    failed: bool = False
    error: str | None = None
    meta: dict[str, str] = field(default_factory=dict)


def splice(template: str, marker: str, text: str | None) -> str:
    """The template with the marked block's slot filled, or without the block where there is no text."""
    block = re.compile(rf"<<<{marker}\n(.*?){marker}>>>\n", re.S)
    if text is None:
        return block.sub("", template)
    return block.sub(lambda m: m[1].replace(SLOTS[marker], text), template)


def fit(excerpts: DataFrame, budget: int, by: list[str], text: str = "excerpt") -> DataFrame:
    """Excerpts cut to an equal share of the budget (in tokens) where a group's are over it together; none is dropped."""
    sized = excerpts.withColumn("_est", token_estimate(F.col(text)))
    share = sized.groupBy(*by).agg(F.sum("_est").alias("_total"), F.count(F.lit(1)).alias("_n"))
    limit = (F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_n"))) * 4).cast("int")
    cut = F.when(F.col("_total") > budget, F.substring(F.col(text), F.lit(1), limit)).otherwise(F.col(text))
    return sized.join(share, by).withColumn(text, cut).drop("_est", "_total", "_n")


def shown_clusters(scored: DataFrame, events: DataFrame, top: int = TOP, budget: int = CONTEXT - RESERVE) -> DataFrame:
    """(case_id, rank, event_id, excerpt): the representative exemplar of each top cluster whose event is known."""
    rows = scored.where((F.col("rank") <= top) & F.col("exemplar_event_id").isNotNull()).select("case_id", "rank", F.col("exemplar_event_id").alias("event_id"))
    return fit(rows.join(events.select("case_id", "event_id", F.col("message").alias("excerpt")), ["case_id", "event_id"]), budget, ["case_id"])


def prompted_ids(shown: DataFrame, *fact_ids: DataFrame) -> DataFrame:
    """(case_id, event_id): all that may be cited; knowledge never is."""
    out = shown.select("case_id", "event_id")
    for ids in fact_ids:
        out = out.unionByName(ids.select("case_id", "event_id"))
    return out.distinct()


def citations_valid(hypotheses: DataFrame, prompted: DataFrame) -> DataFrame:
    """hypotheses with citations_valid: every supporting id was shown; a hypothesis that cites nothing is valid."""
    cited = hypotheses.select("case_id", "hyp_index", F.explode("supporting_event_ids").alias("event_id")).distinct()
    unknown = cited.join(prompted, ["case_id", "event_id"], "left_anti").select("case_id", "hyp_index").distinct().withColumn("_bad", F.lit(True))
    return hypotheses.join(unknown, ["case_id", "hyp_index"], "left").withColumn("citations_valid", F.col("_bad").isNull()).drop("_bad")


def validate(raw: str) -> tuple[dict | None, str]:
    """The answer, or what is wrong with it; unknown and missing keys and wrong types are errors."""
    try:
        answer = json.loads(raw)
        if not isinstance(answer, dict) or set(answer) != {"hypotheses", "timeline_summary", "unexplained_signals"}:
            raise ValueError("the object has hypotheses, timeline_summary and unexplained_signals")
        if not isinstance(answer["timeline_summary"], str) or not _strings(answer["unexplained_signals"]) or not isinstance(answer["hypotheses"], list):
            raise ValueError("wrong type at the top level")
        for n, h in enumerate(answer["hypotheses"]):
            if not isinstance(h, dict) or set(h) != _KEYS:
                raise ValueError(f"hypothesis {n}: keys must be {', '.join(sorted(_KEYS))}")
            if not all(isinstance(h[k], str) for k in _TEXTS) or h["confidence"] not in CONFIDENCES or not _strings(h["supporting_event_ids"]) or not _strings(h["suggested_next_steps"]) or not isinstance(h["contradicting_evidence"], (str, type(None))):
                raise ValueError(f"hypothesis {n}: wrong type or confidence")
    except ValueError as e:
        return None, str(e)
    return answer, ""


def _strings(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def _cites_only(answer: dict, prompted: set[str]) -> bool:
    return all(set(h["supporting_event_ids"]) <= prompted for h in answer["hypotheses"])


def assemble(shown: list[tuple[str, str]], facts: dict[str, tuple[str, set[str]]], knowledge: list[str], hint: str | None, template: str = PROMPT) -> tuple[str, set[str]]:
    """The prompt, and the ids that it shows. facts: text and ids by marker; knowledge is shown but not citable."""
    text = splice(template, "KB", "\n\n".join(re.sub(r"[^\S\n\t ]|[\x00-\x08\x0b-\x1f\x7f]", "", k) for k in knowledge) if knowledge else None)
    for marker in ("MCM", "PERFMON", "EUSTACK"):
        text = splice(text, marker, facts[marker][0] if marker in facts else None)
    text += "".join(f"[evt:{i}] {excerpt}\n" for i, excerpt in shown)
    if hint:
        text += f"\nOperator hint (context only, not evidence): {hint}\n"
    return text, {i for i, _ in shown} | {i for _, ids in facts.values() for i in ids}


def ask(chat: Chat, prompt: str, prompted: set[str]) -> Outcome:
    """Ask, repair a malformed answer once, and ask anew once where ids are cited that were not shown.

    An answer that stays malformed is kept as raw text, one that still cites other ids is kept with those marked: both are degraded. An
    error of the model itself fails the run.
    """
    messages = [{"role": "user", "content": prompt}]
    try:
        raw = chat(messages)
        answer, wrong = validate(raw)
        if answer is None:
            repair = f"Your answer was rejected:\n{wrong}\n\nIt was:\n{raw}\n\nReturn the corrected JSON object only."
            raw = chat([*messages, {"role": "user", "content": repair}])
            answer, wrong = validate(raw)
        if answer is None:
            return Outcome(None, prompt, prompted, raw=raw, degraded=True)
        if not _cites_only(answer, prompted):
            again, _ = validate(chat(messages))
            answer = again or answer
            if not _cites_only(answer, prompted):
                return Outcome(answer, prompt, prompted, degraded=True)
        return Outcome(answer, prompt, prompted)
    except (OSError, ValueError) as e:
        return Outcome(None, prompt, prompted, failed=True, error=str(e) or type(e).__name__)


SCHEMA = "case_id string, hyp_index int, title string, narrative string, confidence string, confidence_reasoning string, supporting_event_ids array<string>, contradicting_evidence string, suggested_next_steps array<string>, citations_valid boolean"


def rows_of(spark: SparkSession, case_id: str, outcome: Outcome) -> DataFrame:
    """The outcome's hypotheses as rows, each with its own citation verdict; ids stay as given."""
    answer = outcome.answer or {"hypotheses": []}
    rows = [(case_id, n, h["title"], h["narrative"], h["confidence"], h["confidence_reasoning"], h["supporting_event_ids"], h["contradicting_evidence"], h["suggested_next_steps"], set(h["supporting_event_ids"]) <= outcome.prompted) for n, h in enumerate(answer["hypotheses"])]
    return spark.createDataFrame(rows, SCHEMA)


def context_of(configured: int | None, reported: int | None, fallback: int = CONTEXT) -> int:
    """The context window: as configured, else as the server reports, else the fallback; numbers below 1 count as none."""
    return next((n for n in (configured, reported) if n and n > 0), fallback)


def tokens(text: Column) -> Column:
    return token_estimate(text)
