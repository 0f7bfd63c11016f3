"""A case store: Parquet tables in a shared folder, keyed by case_id.

A table is a folder of versions; `current` names the one that readers see. A write makes a new version in full and then moves the
pointer, so readers see all of a write or none, and a write that dies leaves the version before. Appends add files to a new version
of nothing but the new rows (versions list their parts), so they never rewrite old rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import clusters as cl
from .operators import events as ev
from .operators.vectors import nearest
from .schema import EVENT, canonical_order

#: Table schemas; every table has case_id.
TABLES = {
    "events": EVENT,
    "parse_stats": "case_id string, source_file string, adapter string, total_bytes long, unknown_bytes long, event_count long, notes array<string>, error string, coverage double",
    "template_groups": "case_id string, template_id string, template string, count long, first_ts timestamp, last_ts timestamp, severity_max string, exemplar_event_ids array<string>",
    "clusters": "case_id string, cluster_id long, signature string, severity_max string, count long, template_ids array<string>, exemplar_event_id string, first_ts timestamp, last_ts timestamp, label string",
    "chunks": "case_id string, chunk_id long, text string", "vectors": "case_id string, chunk_id long, embedding array<float>",
    "kb_chunks": "case_id string, chunk_id long, source_file string, text string", "kb_vectors": "case_id string, chunk_id long, embedding array<float>",
    "hypotheses": "case_id string, hyp_index int, title string, narrative string, confidence string, confidence_reasoning string, supporting_event_ids array<string>, contradicting_evidence string, suggested_next_steps array<string>, citations_valid boolean",
    "verdicts": "case_id string, seq long, verdict_id string, target_type string, target_id string, verdict string, note string, context string, provenance string, created_at timestamp",
    "meta": "case_id string, key string, value string, version long",
}
#: Vocabularies of verdicts.
TARGET_TYPES, VERDICTS = ("hypothesis", "cluster", "template"), ("confirm", "reject", "uncertain")


class CaseNotFound(LookupError):
    """No such case."""


class VerdictError(ValueError):
    """A verdict with a wrong target, type or word."""


class Store:
    """Tables below a folder that all executors see; all paths go through Spark's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._held: dict[str, list[str]] | None = None

    # Versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_pointer(self, table: str) -> list[str]:
        if self._held is not None and table in self._held:
            return self._held[table]
        fs, path = self._fs(f"{self.folder}/{table}/current")
        if not fs.exists(path):
            return []
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{table}/current").collect()))

    def _move_pointer(self, table: str, parts: list[str]) -> None:
        if self._held is not None:
            self._held[table] = parts
            return
        fs, path = self._fs(f"{self.folder}/{table}/current")
        _, new = self._fs(f"{self.folder}/{table}/current-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        fs.delete(path, False)
        if not fs.rename(new, path):
            raise OSError(f"could not commit {table}")

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes inside become visible together at the end, and not at all after an error."""
        if self._held is not None:  # nested: an error undoes the inner writes only
            before = {k: list(v) for k, v in self._held.items()}
            try:
                yield
            except BaseException:
                self._held = before
                raise
            return
        self._held = {}
        try:
            yield
        except BaseException:
            self._held = None
            raise
        moved, self._held = self._held, None
        for table, parts in moved.items():
            self._move_pointer(table, parts)

    # Rows

    def table(self, name: str) -> DataFrame:
        """The table as it stands; empty if nothing was written."""
        parts = self._read_pointer(name)
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.folder}/{name}/{p}" for p in parts])

    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).write.parquet(f"{self.folder}/{name}/{part}")
        return part

    def append(self, name: str, rows: DataFrame) -> None:
        self._move_pointer(name, [*self._read_pointer(name), self._write(name, rows)])

    def replace(self, name: str, rows: DataFrame, case_id: str | None = None) -> None:
        """The rows instead of the table's, or of one case's; other cases keep theirs."""
        if case_id is not None:
            rows = rows.unionByName(self.table(name).where(F.col("case_id") != case_id), allowMissingColumns=True)
        self._move_pointer(name, [self._write(name, rows)])

    def drop(self, name: str, case_id: str) -> int:
        """Empties a case's part of a table; how many rows that were."""
        count = self.table(name).where(F.col("case_id") == case_id).count()
        if count:
            self.replace(name, self.table(name).where(F.col("case_id") != case_id))
        return count

    # Events

    def insert_events(self, arriving: DataFrame) -> int:
        """Appends the events that are new by (case_id, event_id), the first of each; how many those were."""
        new = ev.new_events(self.table("events"), arriving)
        before = self.table("events").count()
        self.append("events", new)
        return self.table("events").count() - before

    def events(self, case_id: str, filters: dict[str, str] | None = None, sources: Iterable[str] | None = None) -> DataFrame:
        rows = self.table("events").where(F.col("case_id") == case_id)
        if sources is not None:
            rows = rows.where(F.col("source").isin(*sources))
        return ev.query_events(rows, filters or {})

    def events_by_ids(self, case_id: str, ids: Iterable[str]) -> DataFrame:
        """The events with these ids; unknown ids have no row."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "event_id string")
        return self.table("events").where(F.col("case_id") == case_id).join(wanted, "event_id", "left_semi")

    # Derived tables

    def template_groups(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        return ev.apply_filters(self.table("template_groups").where(F.col("case_id") == case_id), filters or {}, ev.GROUP_FILTERS, cl.group_order())

    def clusters(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        return ev.apply_filters(self.table("clusters").where(F.col("case_id") == case_id), filters or {}, ev.CLUSTER_FILTERS, cl.cluster_order())

    def hypotheses(self, case_id: str) -> DataFrame:
        return self.table("hypotheses").where(F.col("case_id") == case_id).orderBy("hyp_index")

    def set_labels(self, case_id: str, labels: DataFrame) -> None:
        """New labels by cluster_id; clusters without a new one keep theirs."""
        rows = cl.with_labels(self.clusters(case_id), labels.withColumn("case_id", F.lit(case_id)))
        self.replace("clusters", rows, case_id)

    # Vectors

    def dimension(self, name: str = "vectors") -> int | None:
        row = self.table(name).select(F.size("embedding").alias("n")).first()
        return row.n if row else None

    def upsert_vectors(self, rows: DataFrame, name: str = "vectors") -> None:
        """Rows by (case_id, chunk_id) instead of those with the same key; all vectors of a table have one length."""
        cl.checked_vectors(rows)
        size, held = rows.select(F.size("embedding").alias("n")).first(), self.dimension(name)
        if size and held is not None and size.n != held:
            raise ValueError(f"vectors have {size.n} dimensions, the table has {held}")
        self.replace(name, ev.upsert(self.table(name), rows, ["case_id", "chunk_id"]))

    def drop_vectors(self, case_id: str) -> tuple[int, int]:
        """Empties both vector tables of a case; how many vectors and knowledge vectors those were."""
        counts = self.drop("vectors", case_id), self.drop("kb_vectors", case_id)
        self.set_meta(case_id, {"embedding_dim": None, "kb_embedding_dim": None})
        return counts

    def record_embedding_identity(self, case_id: str, model: str, dimension: int, **knobs: int) -> None:
        self.set_meta(case_id, {"embedding_model": model, "embedding_dim": str(dimension), **{f"embedding_{k}": str(v) for k, v in knobs.items()}})

    def vectors_by_text(self, case_id: str) -> DataFrame:
        mine = F.col("case_id") == case_id
        return cl.vectors_by_text(self.table("chunks").where(mine), self.table("vectors").where(mine).drop("case_id"))

    def nearest_knowledge(self, case_id: str, query: list[float], k: int = 5) -> DataFrame:
        """The texts of the k knowledge chunks nearest to the query."""
        mine = F.col("case_id") == case_id
        found = nearest(self.table("kb_vectors").where(mine).drop("case_id"), query, k, "chunk_id")
        return found.join(self.table("kb_chunks").where(mine), "chunk_id").select("chunk_id", "text", "distance").orderBy("distance", "chunk_id")

    # Meta

    def set_meta(self, case_id: str, values: dict[str, str | None]) -> None:
        """Keys to values; the last one written counts, None takes a key away."""
        version = self.table("meta").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        self.append("meta", self.spark.createDataFrame([(case_id, k, v, version) for k, v in values.items()], TABLES["meta"]))

    def meta(self, case_id: str) -> dict[str, str]:
        rows = ev.latest(self.table("meta").where(F.col("case_id") == case_id), ["key"], [F.col("version")]).collect()
        return {r.key: r.value for r in sorted(rows) if r.value is not None}

    # Cases

    def cases(self) -> DataFrame:
        """(case_id, created, events, groups, clusters): one row for each case that has meta or events."""
        counts = [self.table(t).groupBy("case_id").agg(F.count(F.lit(1)).alias(n)) for t, n in (("events", "events"), ("template_groups", "groups"), ("clusters", "clusters"))]
        created = ev.latest(self.table("meta").where("key = 'created'"), ["case_id"], [F.col("version")]).select("case_id", F.col("value").alias("created"))
        out = created
        for c in counts:
            out = out.join(c, "case_id", "full")
        zero = F.lit(0).cast("long")
        return out.select("case_id", "created", *(F.coalesce(n, zero).alias(n) for n in ("events", "groups", "clusters"))).orderBy("case_id")

    def create_case(self, case_id: str) -> None:
        self.set_meta(case_id, {"created": datetime.now(timezone.utc).isoformat()})

    def require_case(self, case_id: str) -> None:
        if "created" not in self.meta(case_id) and self.table("events").where(F.col("case_id") == case_id).isEmpty():
            raise CaseNotFound(case_id)

    def drop_case(self, case_id: str) -> None:
        with self.transaction():
            for name in TABLES:
                self.drop(name, case_id)

    # Verdicts

    def record_verdict(self, case_id: str, target: str, verdict: str, note: str = "", settings: dict | None = None) -> dict:
        """Appends a verdict on hypothesis:<n>, cluster:<n> or template:<id> with a snapshot of its target; never changes earlier ones."""
        kind, key = parse_target(target)
        if verdict not in VERDICTS:
            raise VerdictError(f"no verdict: {verdict}")
        context = self._snapshot(case_id, kind, key)
        at = datetime.now(timezone.utc)
        meta = self.meta(case_id)
        provenance = {"recorded_at": at.isoformat(), "case_id": case_id} | {k: meta[k] for k in ("triage_prompt_hash", "triage_model", "embedding_model") if k in meta} | (settings or {})
        seq = self.table("verdicts").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        row = (case_id, seq, uuid.uuid4().hex, kind, key, verdict, note, json.dumps(context, sort_keys=True), json.dumps(provenance, sort_keys=True), at)
        self.append("verdicts", self.spark.createDataFrame([row], TABLES["verdicts"]))
        return {"verdict_id": row[2], "target_type": kind, "target_id": key, "verdict": verdict, "created_at": at.isoformat()}

    def verdicts(self, case_id: str, filters: dict[str, str] | None = None) -> DataFrame:
        """Newest first."""
        return ev.apply_filters(self.table("verdicts").where(F.col("case_id") == case_id), filters or {}, ev.VERDICT_FILTERS, [F.desc("created_at"), F.desc("seq")])

    def latest_verdicts(self, case_id: str, target_type: str | None = None) -> DataFrame:
        if target_type is not None and target_type not in TARGET_TYPES:
            raise VerdictError(f"no target type: {target_type}")
        rows = self.table("verdicts").where(F.col("case_id") == case_id)
        rows = rows if target_type is None else rows.where(F.col("target_type") == target_type)
        return ev.latest(rows, ["target_type", "target_id"], [F.col("created_at"), F.col("seq")])

    def _snapshot(self, case_id: str, kind: str, key: str) -> dict:
        frames = {"hypothesis": (self.hypotheses(case_id), "hyp_index"), "cluster": (self.clusters(case_id), "cluster_id"), "template": (self.template_groups(case_id), "template_id")}
        rows, column = frames[kind]
        row = rows.where(F.col(column).cast("string") == key).first()
        if row is None:
            raise VerdictError(f"no {kind} {key} in this case")
        out = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in row.asDict().items() if k != "case_id"}
        if kind == "hypothesis":
            return out | cited_evidence(self.table("events").where(F.col("case_id") == case_id), row.supporting_event_ids)
        if kind == "cluster":
            members = self.template_groups(case_id).where(F.col("template_id").isin(*row.template_ids)).select("template_id", "template").collect()
            out["templates"] = [t for _, t in sorted((row.template_ids.index(m.template_id), m.template) for m in members)]
        return out


def cited_evidence(events: DataFrame, ids: list[str]) -> dict[str, list[str]]:
    """The distinct masked templates of the cited events, in cited order, and their files; ids without an event are left out."""
    from .functions.text import mask

    wanted = events.sparkSession.createDataFrame([(n, i) for n, i in enumerate(ids)], "n int, event_id string")
    rows = events.join(wanted, "event_id").select("n", mask("message").alias("template"), "source_file").collect()
    return {"evidence_templates": list(dict.fromkeys(r.template for r in sorted(rows))), "sources": sorted({r.source_file for r in rows})}


def parse_target(spec: str) -> tuple[str, str]:
    """(type, id) of `type:id`; numbers lose leading zeros."""
    kind, found, key = spec.strip().partition(":")
    if not found or kind not in TARGET_TYPES or not key:
        raise VerdictError(f"not <type>:<id> with type one of {', '.join(sorted(TARGET_TYPES))}: {spec!r}")
    if kind != "template":
        if not key.isdecimal():
            raise VerdictError(f"{kind} id must be a non-negative integer, got {key!r}")
        key = str(int(key))
    return kind, key


def review_progress(levels: DataFrame, ruled: DataFrame) -> DataFrame:
    """(target_type, total, ruled): how many of the targets (target_type, target_id) have a verdict; each counts once, and verdicts on what is gone do not."""
    seen = ruled.select("target_type", "target_id").distinct().withColumn("_ruled", F.lit(1))
    return levels.distinct().join(seen, ["target_type", "target_id"], "left").groupBy("target_type").agg(F.count(F.lit(1)).alias("total"), F.count("_ruled").alias("ruled"))


def current_targets(store: Store, case_id: str) -> DataFrame:
    frames = (("hypothesis", store.hypotheses(case_id), "hyp_index"), ("cluster", store.clusters(case_id), "cluster_id"), ("template", store.template_groups(case_id), "template_id"))
    out = None
    for kind, rows, column in frames:
        part = rows.select(F.lit(kind).alias("target_type"), F.col(column).cast("string").alias("target_id"))
        out = part if out is None else out.unionByName(part)
    return out


class Pager:
    """Pages of an event frame in canonical order, one after the other; each is a bounded top-k after the last key, and pages read stay."""

    def __init__(self, events: DataFrame, size: int = 200):
        self._events, self.size, self._pages = events, size, []

    def page(self, index: int) -> list:
        while len(self._pages) <= index:
            if self._pages and len(self._pages[-1]) < self.size:
                return []
            last = self._pages[-1][-1].asDict() if self._pages else None
            self._pages.append(ev.page_after(self._events, last, self.size).collect())
        return self._pages[index]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*canonical_order())


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
