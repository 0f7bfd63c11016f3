"""The command API: cases from ingest to reports. Each method is what one command does; frames stay lazy until asked for."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from enum import IntEnum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.text import short_hash
from .models import determinism_warnings, embedder
from .operators import clusters, counters, denials, evaluation, facts, knowledge, stacks, templates, triage
from .render import documents, tables
from .sources import ingest
from .store import Pager, Store, current_targets, review_progress


class Exit(IntEnum):
    """What a command came to."""

    SUCCESS = 0
    ERROR = 1
    USAGE = 2
    DEGRADED = 3


class IngestError(RuntimeError):
    """No file of a folder could be read."""


class Engine:
    """Cases in a store, with settings, and, if given, a model's chat and embed functions."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, chat: triage.Chat | None = None, embed: Callable | None = None):
        self.spark, self.config, self.chat = spark, config or Config(), chat
        self.store, self.embed = Store(spark, folder), embedder(embed)

    # Cases

    def new_case(self, case_id: str) -> None:
        if not case_id or not all(c.isalnum() or c in "-_." for c in case_id) or case_id.startswith("."):
            raise ValueError(f"not a case name: {case_id!r}")
        self.store.create_case(case_id)

    def cases(self) -> DataFrame:
        return self.store.cases()

    def drop_case(self, case_id: str) -> None:
        self.store.require_case(case_id)
        self.store.drop_case(case_id)

    def ingest(self, case_id: str, folder: str, overrides: dict[str, str] | None = None) -> DataFrame:
        """Reads a folder into the case: new events, statistics of the files, and the template groups anew. Returns the statistics."""
        events, stats = ingest.read_artifacts(self.spark, folder, case_id, self.config.adapters | (overrides or {}), self.config.timezones)
        with self.store.transaction():
            self.store.insert_events(events)
            self.store.replace("parse_stats", stats, case_id)
            mine = self.store.table("events").where(F.col("case_id") == case_id)
            self.store.replace("template_groups", templates.template_groups(mine), case_id)
        found = self.store.table("parse_stats").where(F.col("case_id") == case_id)
        if not found.isEmpty() and found.where("error is null").isEmpty():
            raise IngestError(f"no file below {folder} could be read")
        return found

    # Showing

    def events(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        return self.store.events(case_id, filters)

    def groups(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        return self.store.template_groups(case_id, filters)

    def clusters(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        return self.store.clusters(case_id, filters)

    def hypotheses(self, case_id: str) -> DataFrame:
        return self.store.hypotheses(case_id)

    def pager(self, case_id: str, size: int = 200) -> Pager:
        return Pager(self.store.table("events").where(F.col("case_id") == case_id), size)

    # Analyses

    def _events(self, case_id: str, *sources: str) -> DataFrame:
        return self.store.table("events").where((F.col("case_id") == case_id) & F.col("source").isin(*sources))

    def _kept(self, frame: DataFrame) -> DataFrame:
        """The frame as a table in the store's folder: what is built on it starts from there."""
        path = f"{self.store.folder}/_scratch/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def _tables(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {name: self._kept(frame) for name, frame in frames.items()}

    def clean(self) -> None:
        """Deletes the tables that analyses kept; their frames can't be read any more."""
        fs, path = self.store._fs(f"{self.store.folder}/_scratch")
        fs.delete(path, True)

    def mcm(self, case_id: str) -> dict[str, DataFrame]:
        return self._tables(denials.analyse(self._events(case_id, "dsserrors"), self.config.mcm.window_pct, self.config.mcm.thresholds, self._kept))

    def perfmon(self, case_id: str) -> dict[str, DataFrame]:
        events, found = self._events(case_id, "dsserrors", "dssperfmon"), self.mcm(case_id)
        return self._tables(counters.analyse(events, found, self._kept(denials.span_events(events, found["episodes"])), keep=self._kept))

    def rules(self) -> list[stacks.Rule]:
        return stacks.read_rules(self.config.eustack.rules_path)[0] if self.config.eustack.rules_path else []

    def eustack(self, case_id: str) -> dict[str, DataFrame]:
        return self._tables(stacks.analyse(self._events(case_id, "eustack"), self.rules(), self.config.eustack.thresholds, self._kept))

    def fact_blocks(self, case_id: str) -> dict[str, DataFrame]:
        """The fact block of each analyser whose sources the case has."""
        have = {r.source for r in self._events(case_id, *facts.sources()).select("source").distinct().collect()}
        frames = {"mcm": self.mcm, "perfmon": self.perfmon, "eustack": self.eustack}
        return {marker: self._kept(block(frames[name](case_id))) for name, (marker, sources, block) in facts.ANALYSERS.items() if sources[-1] in have}

    def scored(self, case_id: str, incident: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
        return templates.salience(self.store.clusters(case_id), incident, since, until)

    def index_knowledge(self, case_id: str, folder: str) -> int:
        chunks, vectors = knowledge.index(knowledge.read_markdown(self.spark, folder), self.embed, case_id)
        with self.store.transaction():
            self.store.replace("kb_chunks", chunks, case_id)
            self.store.replace("kb_vectors", vectors, case_id)
        return self.store.table("kb_chunks").where(F.col("case_id") == case_id).count()

    def build_clusters(self, case_id: str, again: bool = False, label: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Clusters of the case's template groups; vectors of texts known from before are reused unless `again`."""
        if again:
            self.store.drop_vectors(case_id)
        groups = self.store.template_groups(case_id)
        events = self.store.table("events").where(F.col("case_id") == case_id)
        known = self.store.vectors_by_text(case_id)
        texts = clusters.exemplar_texts(groups, events).select("text").distinct()
        fresh = self.embed(texts.join(known, "text", "left_anti")).select(F.lit(case_id).alias("case_id"), F.xxhash64("text").alias("chunk_id"), "text", F.col("embedding").cast("array<float>").alias("embedding"))
        with self.store.transaction():
            before = self.store.table("chunks").where(F.col("case_id") == case_id)
            self.store.replace("chunks", before.unionByName(fresh.select("case_id", "chunk_id", "text")).dropDuplicates(["chunk_id"]), case_id)
            self.store.upsert_vectors(fresh.select("case_id", "chunk_id", "embedding"))
        found = clusters.cluster_groups(groups, events, self.store.vectors_by_text(case_id), self.embed, self.config.clustering.method, label)
        self.store.replace("clusters", found, case_id)
        return self.store.clusters(case_id)

    def analyze(self, case_id: str, incident: str | None = None, since: str | None = None, until: str | None = None, top: int = triage.TOP, hint: str | None = None, use_knowledge: bool = False, again: bool = False, label: Callable[[DataFrame], DataFrame] | None = None) -> Exit:
        """Clusters, ranking, facts and, with a model, hypotheses; what is kept is replaced as a whole."""
        self.store.require_case(case_id)
        self.build_clusters(case_id, again, label)
        if self.chat is None:
            return Exit.SUCCESS
        events = self.store.table("events").where(F.col("case_id") == case_id)
        shown = triage.shown_clusters(self.scored(case_id, incident, since, until), events, top).orderBy("rank").collect()
        blocks = {}
        for marker, block in self.fact_blocks(case_id).items():
            text = facts.block_text(block).first()
            if text:
                blocks[marker] = (text.text, {r.event_id for r in facts.cited_ids(block).collect()})
        chunks = []
        if use_knowledge:
            mine = F.col("case_id") == case_id
            queries = self.spark.createDataFrame([(r.excerpt,) for r in shown], "text string")
            found = knowledge.retrieve(self.store.table("kb_chunks").where(mine), self.store.table("kb_vectors").where(mine), queries, self.embed)
            chunks = [r.text for r in found.collect()]
        prompt, prompted = triage.assemble([(r.event_id, r.excerpt) for r in shown], blocks, chunks, hint)
        outcome = triage.ask(self.chat, prompt, prompted)
        if outcome.failed:
            return Exit.ERROR
        answer = outcome.answer or {}
        prompt_hash = self.spark.range(1).select(short_hash(F.lit(prompt)).alias("h")).first().h
        with self.store.transaction():
            self.store.replace("hypotheses", triage.rows_of(self.spark, case_id, outcome), case_id)
            self.store.set_meta(case_id, {
                "triage_degraded": "1" if outcome.degraded else "0", "triage_prompt_hash": prompt_hash, "triage_created_at": datetime.now(timezone.utc).isoformat(), "triage_model": self.config.generation.model,
                "triage_timeline_summary": answer.get("timeline_summary"), "triage_unexplained_signals": json.dumps(answer.get("unexplained_signals", [])), "triage_raw": outcome.raw,
            })
        return Exit.DEGRADED if outcome.degraded else Exit.SUCCESS

    # Reports and verdicts

    def report(self, case_id: str, form: str = "md") -> str:
        self.store.require_case(case_id)
        return documents.to_json(documents.triage_document(self.store, case_id)) if form == "json" else documents.triage_markdown(self.store, case_id)

    def bundle(self, case_id: str, kind: str, form: str = "md") -> str:
        """The report of one analysis (mcm, perfmon or eustack), as md or json."""
        frames, document, markdown = {"mcm": (self.mcm, documents.denial_document, documents.denial_markdown), "perfmon": (self.perfmon, documents.counter_document, documents.counter_markdown), "eustack": (self.eustack, documents.stack_document, documents.stack_markdown)}[kind]
        found = document(frames(case_id))
        return documents.to_json(found) if form == "json" else markdown(found)

    def write_bundle(self, case_id: str, kind: str, folder: str, form: str = "md") -> Exit:
        """The report file and its CSV table in a folder of the driver; neither stays if one fails."""
        report, table = Path(folder) / f"{kind}.{form}", Path(folder) / f"{kind}.csv"
        rows = {"mcm": (self.mcm, tables.attribution_rows), "perfmon": (self.perfmon, tables.trend_rows), "eustack": (self.eustack, tables.signature_rows)}[kind]
        try:
            Path(folder).mkdir(parents=True, exist_ok=True)
            report.write_text(self.bundle(case_id, kind, form), encoding="utf-8")
            rows[1](rows[0](case_id)).toPandas().to_csv(table, index=False)  # a report's table, a few hundred rows
        except OSError:
            for path in (report, table):
                path.unlink(missing_ok=True)
            return Exit.ERROR
        return Exit.SUCCESS

    def record_verdict(self, case_id: str, target: str, verdict: str, note: str = "") -> dict:
        return self.store.record_verdict(case_id, target, verdict, note)

    def review(self, case_id: str) -> DataFrame:
        return review_progress(current_targets(self.store, case_id), self.store.verdicts(case_id))

    # Evaluation

    def evaluate(self, truths: dict[str, evaluation.Truth], floors: dict[str, float], top: int = triage.TOP) -> tuple[DataFrame, DataFrame]:
        """Metrics of the cases that were analysed before, and the gate's rows; a case without clusters and stacks failed."""
        rows = []
        for name, truth in sorted(truths.items()):
            rows.append(self._evaluated(name, truth, top))
        cases = self.spark.createDataFrame(rows, evaluation.CASES)
        return cases, evaluation.gate(evaluation.suite_means(cases), floors)

    def _evaluated(self, case_id: str, truth: evaluation.Truth, top: int) -> tuple:
        spark = self.spark
        one = spark.createDataFrame([(case_id,)], "case_id string")
        try:
            if truth.expect_eustack:
                expect = spark.createDataFrame(evaluation.expected_figures(case_id, truth.expect_eustack), "case_id string, kind string, key string, value long")
                verdict = evaluation.stack_verdict(self.eustack(case_id), expect).first()
                return (case_id, 0.0, 0.0, 0.0, 0.0, False, None, False, True, bool(verdict and verdict.eustack_case_pass))
            events = self.store.table("events").where(F.col("case_id") == case_id)
            texts = evaluation.exemplar_texts(self.scored(case_id), self.store.template_groups(case_id), events, top)
            patterns = spark.createDataFrame([(case_id, p) for p in truth.required_evidence or [None]], "case_id string, pattern string")
            keywords = spark.createDataFrame([(case_id, k) for k in truth.acceptable_keywords or [None]], "case_id string, keyword string")
            hypotheses = self.store.hypotheses(case_id)
            docs = [json.dumps(documents.normalised(documents.triage_document(self.store, case_id)), sort_keys=True) for _ in range(2)]
            determinism = evaluation.determinism(spark.createDataFrame([(case_id, d) for d in docs], "case_id string, document string"))
            figures = [f.first()[1] for f in (evaluation.retrieval_hit_rate(texts, patterns), evaluation.hit_at_k(hypotheses, keywords), evaluation.citation_validity(hypotheses, one), determinism)]
            return (case_id, *figures, truth.expect_no_incident, evaluation.negative_pass(hypotheses, one).first()[1], False, False, None)
        except (OSError, ValueError, LookupError):
            return (case_id, 0.0, 0.0, 0.0, 0.0, truth.expect_no_incident, None, True, False, None)

    def doctor(self, server=None) -> list[str]:
        """What stands in the way of repeatable runs; empty if nothing."""
        return determinism_warnings(server.properties()) if server is not None else []
