"""Reports as canonical JSON and as Markdown.

A report reads the small result frames of one case, each in its own total order, so the same case always gives the same text. JSON is
the whole report; Markdown shows its parts as tables.
"""

from __future__ import annotations

import json
import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import cut_bytes
from ..operators.stacks import report_order
from ..store import Store

#: Bytes of a raw text in a report, keys that hold times of the run, and marks of keys that name paths or durations.
RAW = 2048
VOLATILE = ("generated_at",)
PATHS, DURATIONS = ("path", "file", "dir"), ("duration", "elapsed", "wall")


def plain(value):
    """A collected value as JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value.isoformat() if isinstance(value, datetime) else value


def rows_of(frame: DataFrame, order: list[Column] | None = None, drop: tuple[str, ...] = ("case_id",)) -> list[dict]:
    shown = frame.orderBy(*order) if order else frame
    return [plain(r) for r in shown.drop(*drop).collect()]


def to_json(document: dict) -> str:
    """Sorted keys, ASCII, a newline at the end."""
    return json.dumps(document, sort_keys=True, ensure_ascii=True, indent=2) + "\n"


def normalised(document):
    """The document without times of the run, absolute paths under path keys, and durations; for comparing runs."""
    if isinstance(document, dict):
        held = lambda k, v: k in VOLATILE or any(m in k.lower() for m in DURATIONS) or (any(m in k.lower() for m in PATHS) and isinstance(v, str) and v.startswith("/"))
        return {k: normalised(v) for k, v in document.items() if not held(k, v)}
    return [normalised(v) for v in document] if isinstance(document, list) else document


# Documents


def denial_document(denials: dict[str, DataFrame]) -> dict:
    """Episodes in order, each with its window, lifecycle, memory picture, flags and attribution."""
    place = [F.col("denial_place")]
    parts = {name: _by(rows_of(denials[name], order), "denial_event_id") for name, order in {"windows": None, "lifecycle": [F.col("position")], "breakdowns": None, "flags": [F.col("position")], "attribution": [F.col("dimension"), F.desc("granted_bytes"), F.col("key")], "unmatched": None}.items()}
    out = []
    for e in rows_of(denials["episodes"].drop("span_to", "span_from", "closed", "after_from"), place):
        e.pop("denial_place")
        own = {name: found.get(e["denial_event_id"], []) for name, found in parts.items()}
        out.append({"episode": e, "window": next(iter(own["windows"]), None), "lifecycle": own["lifecycle"], "breakdown": next(iter(own["breakdowns"]), None), "flags": own["flags"], "attribution": {d: [r for r in own["attribution"] if r["dimension"] == d] for d in ("oid", "source", "sid")}, "unmatched_event_ids": own["unmatched"][0]["event_ids"] if own["unmatched"] else []})
    return {"episodes": out}


def _by(rows: list[dict], key: str) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r.pop(key), []).append(r)
    return out


def counter_document(counters: dict[str, DataFrame]) -> dict:
    """Groups, each with its counters by name and its hazards."""
    key = F.concat_ws("\0", "scope", "key")
    trends = _by(rows_of(counters["counters"].withColumn("_k", key), [F.col("counter")], ("case_id", "scope", "key")), "_k")
    hazards = _by(rows_of(counters["hazards"].withColumn("_k", key), [F.col("dimension")], ("case_id", "scope", "key")), "_k")
    groups = rows_of(counters["groups"], [F.col("scope"), F.col("start_ts").asc_nulls_last(), F.col("key")])
    return {"groups": [g | {"counters": trends.get(f"{g['scope']}\0{g['key']}", []), "hazards": hazards.get(f"{g['scope']}\0{g['key']}", [])} for g in groups]}


def stack_document(stacks: dict[str, DataFrame]) -> dict:
    """The latest dump's frames, all dumps and the progression."""
    latest = lambda name: rows_of(stacks[name].where("latest"), report_order(name), ("case_id", "dump", "dump_idx", "latest"))
    return {"dumps": rows_of(stacks["dumps"], report_order("dumps")), "basis": rows_of(stacks["basis"]), **{n: latest(n) for n in ("roles", "signatures", "pools", "lock_sites", "dependencies", "flags")}, "progression": rows_of(stacks["progression"], report_order("progression"))}


def triage_document(store: Store, case_id: str) -> dict:
    """Hypotheses, clusters, verdicts (newest first), summary and run of an analysed case."""
    meta = store.meta(case_id)
    return {
        "hypotheses": rows_of(store.hypotheses(case_id)),
        "clusters": rows_of(store.clusters(case_id).select("cluster_id", "label", "signature", "severity_max", "count")),
        "timeline_summary": meta.get("triage_timeline_summary", ""), "unexplained_signals": json.loads(meta.get("triage_unexplained_signals") or "[]"),
        "verdicts": rows_of(store.verdicts(case_id)),
        "run": {"model": meta.get("triage_model"), "prompt_hash": meta.get("triage_prompt_hash"), "embedding_model": meta.get("embedding_model"), "degraded": meta.get("triage_degraded") == "1", "generated_at": meta.get("triage_created_at")},
    }


# Markdown


def safe(value) -> str:
    """A value in a Markdown cell: one line, no control characters, nothing that Markdown or HTML reads."""
    text = "" if value is None else "yes" if value is True else "no" if value is False else str(value)
    text = re.sub(r"[\x00-\x08\x0b-\x1f\x7f-\x9f​-‏‪-‮⁠-⁤﻿]", "", text)
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"\s*[\n\t]+\s*", " ", re.sub(r"([\\`*_{}\[\]()#+!|~-])", r"\\\1", text))


def table(rows: list[dict], columns: list[str]) -> list[str]:
    """A Markdown table, or a line that says there is nothing."""
    if not rows:
        return ["_None._", ""]
    cell = lambda v: safe("; ".join(map(str, v)) if isinstance(v, list) else v)
    return ["| " + " | ".join(c.replace("_", " ") for c in columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows), ""]


def _section(title: str, rows: list[dict], columns: list[str], depth: int = 3) -> list[str]:
    return [f"{'#' * depth} {title}", "", *table(rows, columns)]


def denial_markdown(document: dict) -> str:
    episodes = document["episodes"]
    out = ["# Memory denials", "", f"{len(episodes)} episode(s)." if episodes else "_No denial episodes detected._", ""]
    for n, e in enumerate(episodes, 1):
        episode = e["episode"]
        out += [f"## Episode {n}: denial at {safe(episode['denial_ts'] or episode['denial_event_id'])}", ""]
        out += ["> **Open** - it never recovered within the log.", ""] * bool(episode["open_truncated"]) + ["> **Fragmented** - its detail block spans a file boundary.", ""] * bool(episode.get("fragmented"))
        out += [f"- Lead-up window: {safe(e['window']['label'])} ({e['window']['request_count']} requests)", ""] if e["window"] else []
        out += _section("Lifecycle", e["lifecycle"], ["kind", "ts", "event_id", "text"]) + _section("Flags", e["flags"], ["dimension", "severity", "value_pct", "message", "event_ids"])
        out += _section("Memory", (e["breakdown"] or {}).get("detail") or [], ["label", "value", "unit"])
        for d in ("oid", "source", "sid"):
            out += _section(f"Attribution by {d}", e["attribution"][d], ["key", "granted_bytes", "request_count", *(["sids"] if d == "oid" else [])])
    return "\n".join(out) + "\n"


def counter_markdown(document: dict) -> str:
    out = ["# Performance counters", ""] + ([] if document["groups"] else ["_No counter samples._", ""])
    for g in document["groups"]:
        out += [f"## {g['scope'].capitalize()} {safe(g['key'])}", "", f"- {safe(g['label'])}", f"- Span: {safe(g['start_ts'])} to {safe(g['end_ts'])}, {g['sample_count']} sample(s)", ""]
        out += _section("Hazards", g["hazards"], ["severity", "dimension", "message", "event_ids"]) + _section("Counters", g["counters"], ["counter", "at_denial", "slope_per_second", "peak", "sample_count", "excluded_samples"])
    return "\n".join(out) + "\n"


def stack_markdown(document: dict) -> str:
    if not document["dumps"]:
        return "# Thread dumps\n\n_No thread dumps in this case._\n"
    changed = [p for p in document["progression"] if p["overall_delta"] or any(p["step_deltas"])]
    parts = (("Dumps", document["dumps"], ["dump", "ts", "ts_confidence", "thread_count"]), ("Ordering", document["basis"], ["basis", "flag"]), ("Roles", document["roles"], ["role", "threads", "signatures"]), ("Pools", document["pools"], ["subsystem", "total", "busy", "idle", "occupancy", "signature_count"]),
             ("Lock sites", document["lock_sites"], ["site", "threads", "signature_count"]), ("Dependencies", document["dependencies"], ["subsystem", "threads", "signature_count"]), ("Flags", document["flags"], ["severity", "dimension", "value", "unit", "message"]),
             ("Signatures", document["signatures"], ["thread_count", "role", "subsystem", "pattern", "reason", "frames"]), ("Changed signatures", changed, ["counts", "overall_delta", "role", "matched_frame", "leaf_frame"]))
    return "\n".join(["# Thread dumps", "", *(line for title, rows, columns in parts for line in _section(title, rows, columns, 2))]) + "\n"


def linked(text: str, known: set[str]) -> str:
    """[evt:id] citations as links to the appendix where it has the event."""
    return re.sub(r"\[evt:([0-9a-f]+)\]", lambda m: f"[{m[1]}](#evt-{m[1]})" if m[1] in known else m[1], text)


def triage_markdown(store: Store, case_id: str) -> str:
    document = triage_document(store, case_id)
    hypotheses, meta = document["hypotheses"], store.meta(case_id)
    cited = sorted({i for h in hypotheses for i in h["supporting_event_ids"]})
    events = store.events_by_ids(case_id, cited).select("event_id", "ts", "source_file", "line_start", "line_end", "severity", cut_bytes(F.col("raw"), RAW).alias("raw")).orderBy("event_id").collect()
    known = {e.event_id for e in events}
    flagged = sum(not h["citations_valid"] for h in hypotheses)
    out = ["# Triage report", ""] + ["> **DEGRADED RUN** - flagged rows need care.", ""] * document["run"]["degraded"]
    out += ["## Summary", "", f"{len(hypotheses)} hypotheses, {len(document['clusters'])} clusters, {flagged} flagged.", "", "## Hypotheses", ""]
    for h in hypotheses:
        out += [f"### {h['hyp_index'] + 1}. {safe(h['title'])} ({h['confidence']}){'' if h['citations_valid'] else ' FLAGGED'}", "", safe(h["narrative"]), "", f"Confidence: {safe(h['confidence_reasoning'])}", "", "Evidence: " + linked(" ".join(f"[evt:{i}]" for i in h["supporting_event_ids"]), known), ""]
        out += [f"Against: {safe(h['contradicting_evidence'])}", ""] if h["contradicting_evidence"] else []
        out += [*(f"- {safe(s)}" for s in h["suggested_next_steps"]), ""]
    if meta.get("triage_raw"):
        out += ["## Raw answer (not valid)", "", *fenced(meta["triage_raw"].encode()[:RAW].decode(errors="ignore")), ""]
    out += ["## Evidence", ""]
    for e in events:
        out += [f'<a id="evt-{e.event_id}"></a>', f"**{e.event_id}** {safe(e.source_file)}:{e.line_start}-{e.line_end} {e.severity} {safe(e.ts.isoformat() if e.ts else 'no time')}", "", *fenced(e.raw), ""]
    out += _section("Clusters", document["clusters"], ["cluster_id", "count", "severity_max", "label", "signature"], 2) + _section("Verdicts", document["verdicts"], ["created_at", "target_type", "target_id", "verdict", "note"], 2)
    out += ["## Timeline", "", safe(document["timeline_summary"]) or "_None._", "", "## Unexplained signals", "", *([f"- {safe(s)}" for s in document["unexplained_signals"]] or ["_None._"]), "", "## Run", "", *(f"- {k.replace('_', ' ')}: {safe(v)}" for k, v in document["run"].items()), ""]
    return "\n".join(out)


def fenced(text: str) -> list[str]:
    """A code block whose fence is longer than any run of backticks in the text."""
    fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", text)), default=0))
    return [fence, re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", text), fence]


def evaluation_table(gate: DataFrame) -> str:
    """The gate's rows as aligned text."""
    rows = gate.collect()
    width = max((len(r.name) for r in rows), default=0)
    shown = lambda x: "   -" if x is None else f"{x:.2f}"
    return "\n".join(f"{r.name:<{width}}  {shown(r.value)}  {shown(r.floor)}  {'PASS' if r.passed else 'FAIL'}" for r in rows) + "\n"


def evaluation_json(cases: DataFrame, gate: DataFrame) -> str:
    return to_json({"cases": rows_of(cases, [F.col("name")]), "gate": rows_of(gate)})
