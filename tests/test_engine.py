"""A case from files to reports, and the streams."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.config import Config, Stacks
from lumenlog.engine import Engine, Exit
from lumenlog.operators import clusters, denials, evaluation, facts, triage
from lumenlog.store import CaseNotFound, VerdictError
from lumenlog.streaming import events as streams

SID, OID = "A" * 32, "B" * 32
RULES = '[meta]\nversion = 1\nvalidated_against = "x"\n[[rule]]\nrole = "blocked-on-lock"\nsubsystem = "lock"\npattern = "lll_wait"\n[[rule]]\nrole = "idle-parked"\nsubsystem = "pool"\nmatch = "prefix"\npattern = "idle"\n'


def server_log() -> str:
    def grant(second, available, oid=f"[OID:{OID}]"):
        return f"2026-01-01 00:00:{second:02}.000 [h][77][Kernel][Info][Mcm.cpp:5][SID:{SID}]{oid} Contract Request Succeeded Size={1048576 * second} Source=Job:{second % 2} AvailableMCM={available} HWM(GB)=4000\n"

    return (
        grant(1, 3000) + grant(2, 900) + grant(3, 2000) + grant(4, 800) + grant(5, 700, "")
        + "2026-01-01 00:00:05.500 [h][77][Kernel][Info][Mcm.cpp:5] Dump\nCurrent Memory Info:\nSystem Total = 1000 (1GB)\nSystem Available = 40 (40MB)\nMCM Settings:\nSmartHeap Cache Releasable = true\n"
        + "2026-01-01 00:00:06.000 [h][77][Kernel][Error][Mcm.cpp:6] IServer enters MCM denial state\n\tTotal In Use Virtual Memory For Intelligence Server(GB): 1\n\tWorking Set Cache RAM Usage(MB): 669\n\tUnused Memory Pool In SmartHeap(MB): 400\nNote: end\n"
        + "2026-01-01 00:00:07.000 [h][77][Kernel][Error][Mcm.cpp:6] IServer enters MCM denial state\n"
        + "2026-01-01 00:00:08.000 [h][77][Kernel][Info][Mcm.cpp:7] Working set emergency offload completed\n"
        + "2026-01-01 00:00:09.000 [h][77][Kernel][Info][Mcm.cpp:8] MCM State=normal\n"
        + grant(10, 3500)
    )


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("case")
    (folder / "node1").mkdir()
    (folder / "node1" / "Errors.log").write_text(server_log())
    rows = "".join(f'"01/01/2026 00:00:0{n}.000","{n * 10}","0"\n' for n in range(1, 9))
    (folder / "perf.csv").write_text('"(PDH-CSV 4.0) (UTC)(0)","\\\\h\\Mem\\RAM used(MB)","\\\\h\\Mcm\\Total MCM Denial"\n' + rows)
    for n, waiting in enumerate((1, 6)):
        threads = "".join(f"TID {t}:\n#0  0x1 lll_wait\n#1  0x2 App::lock\n" for t in range(waiting)) + "TID 99:\n#0  0x3 idle_loop\n"
        (folder / f"dump{n}.txt").write_text(f"2026-01-01T00:00:0{n}Z dump\n{threads}")
    (folder / "rules.toml").write_text(RULES)
    os.remove(folder / "rules.toml")
    rules = tmp_path_factory.mktemp("rules") / "rules.toml"
    rules.write_text(RULES)
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")), Config(eustack=Stacks(rules_path=str(rules))))
    engine.new_case("c1")
    stats = engine.ingest("c1", str(folder))
    assert stats.count() == 4 and stats.where("error is not null").isEmpty()
    return engine, str(folder)


def test_a_second_ingest_adds_nothing(case):
    engine, folder = case
    before = engine.events("c1").count()
    engine.ingest("c1", folder)
    assert engine.events("c1").count() == before
    assert [r.case_id for r in engine.cases().collect()] == ["c1"]
    assert engine.events("c1", {"source": "eustack", "limit": "2"}).count() == 2


def test_pages_follow_one_another(case):
    engine, _ = case
    pager = engine.pager("c1", size=7)
    whole = [r.event_id for r in engine.events("c1").collect()]
    pages = [[r.event_id for r in pager.page(n)] for n in range(5)]
    assert [i for p in pages for i in p] == whole[:35] and pager.page(99) == []


def test_denial_report(case):
    engine, _ = case
    found = json.loads(engine.bundle("c1", "mcm", "json"))["episodes"]
    assert len(found) == 1
    e = found[0]
    # The last descent below a quarter of the mark begins after the grant at second 3.
    assert e["window"]["request_count"] == 2 and e["window"]["hwm_bytes"] == 4000 and e["episode"]["recovery_event_id"] and not e["episode"]["open_truncated"]
    assert {f["dimension"]: (f["severity"], f["value_pct"]) for f in e["flags"]} == {"working_set_pct_virtual": ("critical", 65.3), "smartheap_releasable": ("info", 39.1), "system_free_headroom_pct": ("critical", 4.0)}
    assert [(r["key"], r["granted_bytes"], r["request_count"]) for r in e["attribution"]["oid"]] == [(OID, 4 * 1048576, 1)] and e["attribution"]["oid"][0]["sids"] == [SID]
    assert len(e["unmatched_event_ids"]) == 1 and [s["kind"] for s in e["lifecycle"]] == ["emergency-offload-complete"]
    text = engine.bundle("c1", "mcm")
    assert "65.3" in text and text == engine.bundle("c1", "mcm")


def test_counter_report(case):
    engine, _ = case
    found = json.loads(engine.bundle("c1", "perfmon", "json"))["groups"]
    assert len(found) == 1 and found[0]["scope"] == "episode" and found[0]["sample_count"] == 3
    counters = {c["counter"]: c for c in found[0]["counters"]}
    assert counters["RAM used(MB)"]["at_denial"] == 60.0 and counters["RAM used(MB)"]["slope_per_second"] == 10.0 and counters["RAM used(MB)"]["peak"] == 60.0
    assert [h["dimension"] for h in found[0]["hazards"]] == ["denial_always_zero"] and "RAM used" in engine.bundle("c1", "perfmon")


def test_stack_report(case, tmp_path):
    engine, _ = case
    found = json.loads(engine.bundle("c1", "eustack", "json"))
    assert [d["dump"] for d in found["dumps"]] == ["dump0.txt", "dump1.txt"] and found["basis"] == [{"basis": "timestamp", "flag": None}]
    assert [(s["site"], s["threads"]) for s in found["lock_sites"]] == [("App::lock", 6)]
    assert {f["dimension"]: f["severity"] for f in found["flags"]} == {"unclassified_thread_pct": "info", "no_resolvable_frame_pct": "info", "lock_convergence_count": "warn"}
    assert found["progression"][0]["counts"] == [1, 6] and found["progression"][0]["overall_delta"] == 5
    assert engine.write_bundle("c1", "eustack", str(tmp_path), "json") == Exit.SUCCESS
    assert (tmp_path / "eustack.csv").read_text().splitlines()[0].split(",")[7:] == ["thread_count", "dump0.txt", "dump1.txt", "step_deltas", "overall_delta"]
    assert "App::lock" in engine.bundle("c1", "eustack")


def test_fact_blocks_cite_what_they_print(case):
    engine, _ = case
    blocks = engine.fact_blocks("c1")
    assert set(blocks) == {"MCM", "PERFMON", "EUSTACK"}
    known = {r.event_id for r in engine.events("c1").collect()}
    for marker, block in blocks.items():
        text = facts.block_text(block).first().text
        ids = {r.event_id for r in facts.cited_ids(block).collect()}
        assert ids and ids <= known and all(f"[evt:{i}]" in text for i in ids), marker
    assert "MCM denial at 2026-01-01T00:00:06+00:00" in facts.block_text(blocks["MCM"]).first().text


def test_analysis_verdicts_and_report(case, tmp_path):
    engine, _ = case
    kb = tmp_path / "kb"
    kb.mkdir()
    (kb / "a.md").write_text("MCM denial means that memory ran out")
    assert engine.index_knowledge("c1", str(kb)) == 1
    shown = []

    def chat(messages):
        shown.append(messages[0]["content"])
        cited = messages[0]["content"].split("[evt:")[-1].split("]")[0]
        return json.dumps({"hypotheses": [{"title": "memory", "narrative": "MCM denial", "confidence": "high", "confidence_reasoning": "r", "supporting_event_ids": [cited], "contradicting_evidence": None, "suggested_next_steps": ["s"]}], "timeline_summary": "t", "unexplained_signals": ["u"]})

    engine.chat = chat
    assert engine.analyze("c1", use_knowledge=True, hint="h") == Exit.SUCCESS and len(shown) == 1 and "memory ran out" in shown[0]
    assert engine.analyze("c1") == Exit.SUCCESS  # vectors are reused, results replaced
    assert engine.hypotheses("c1").count() == 1 and engine.hypotheses("c1").first().citations_valid
    total = engine.clusters("c1").agg(F.sum("count")).first()[0]
    assert total == engine.groups("c1").agg(F.sum("count")).first()[0] > 0
    first = engine.record_verdict("c1", "hypothesis:0", "confirm", "yes")
    engine.record_verdict("c1", "hypothesis:00", "reject")
    engine.record_verdict("c1", f"cluster:{engine.clusters('c1').first().cluster_id}", "uncertain")
    assert [r.verdict for r in engine.store.verdicts("c1", {"target-type": "hypothesis"}).collect()] == ["reject", "confirm"]
    assert {(r.target_type, r.verdict) for r in engine.store.latest_verdicts("c1").collect()} == {("hypothesis", "reject"), ("cluster", "uncertain")}
    assert {r.target_type: (r.ruled, r.total) for r in engine.review("c1").collect()}["hypothesis"] == (1, 1)
    context = json.loads(engine.store.verdicts("c1").where(F.col("verdict_id") == first["verdict_id"]).first().context)
    assert context["title"] == "memory" and context["sources"]
    for target, verdict in (("cluster:9999", "confirm"), ("hypothesis:0", "maybe"), ("event:1", "confirm")):
        with pytest.raises(VerdictError):
            engine.record_verdict("c1", target, verdict)
    report = engine.report("c1")
    assert "memory" in report and "Evidence" in report and json.loads(engine.report("c1", "json"))["run"]["degraded"] is False
    truths = {"c1": evaluation.Truth("x", ["denial state", "nothing like it"], ["mcm"])}
    cases, gate = engine.evaluate(truths, dict.fromkeys(evaluation.METRICS, 0.5))
    row = cases.first()
    assert (row.retrieval_hit_rate, row.hypothesis_hit_at_k, row.citation_validity_rate, row.determinism_stability) == (0.5, 1.0, 1.0, 1.0)
    assert not next(r for r in gate.collect() if r.name == "gate").passed  # no stack case
    with pytest.raises(CaseNotFound):
        engine.report("other")


def test_a_failed_transaction_leaves_all_as_it_was(case):
    engine, _ = case
    before = engine.store.meta("c1")
    with pytest.raises(RuntimeError), engine.store.transaction():
        engine.store.set_meta("c1", {"x": "1"})
        raise RuntimeError
    assert engine.store.meta("c1") == before
    with engine.store.transaction():
        engine.store.set_meta("c1", {"x": "2"})
        with pytest.raises(RuntimeError), engine.store.transaction():
            engine.store.set_meta("c1", {"x": "3"})
            raise RuntimeError
    assert engine.store.meta("c1")["x"] == "2"


def test_a_denial_without_detail_before_another_file_is_fragmented(spark):
    schema = "event_id string, case_id string, ts timestamp, source string, source_file string, line_start int, raw string"
    at = datetime(2026, 1, 1)
    rows = [("a", "c", at, "dsserrors", "f1", 1, denials.DENIAL), ("b", "c", at + timedelta(1), "dsserrors", "f2", 1, "more"), ("d", "d", at, "dsserrors", "f1", 1, denials.DENIAL + "\n\tCube Caches In Memory(MB): 5")]
    got = {r.case_id: (r.fragmented, r.open_truncated) for r in denials.analyse(spark.createDataFrame(rows, schema))["episodes"].collect()}
    assert got == {"c": (True, True), "d": (False, True)}


def test_labels(spark):
    rows = spark.createDataFrame([('say {"1": "a", "2": " ", "x": "b"} end',), ("junk",), (None,)], "t string")
    assert [r.x for r in rows.select(clusters.parse_labels(F.col("t")).alias("x")).collect()] == [{"1": "a"}, {}, {}]
    assert triage.fit(spark.createDataFrame([("c", "x" * 100), ("c", "y" * 10)], "case_id string, excerpt string"), 10, ["case_id"]).select(F.length("excerpt").alias("n")).orderBy("n").collect()[1].n == 20


# Streams


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    at = datetime(2026, 1, 1)
    schema = "event_id string, case_id string, ts timestamp, severity string, message string"
    rows = [("a", "c", at, "error", "took 1 ms"), ("a", "c", at, "error", "took 1 ms"), ("b", "c", at + timedelta(minutes=1), "error", "took 22 ms"), ("d", "c", at + timedelta(hours=9), "info", "late")]
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in run(streams.deduplicated(read()), "once")) == ["a", "b", "d"]
    counts = run(streams.template_counts(streams.deduplicated(read()), late=None), "counts")
    assert [(r.template, r["count"], r["rank"]) for r in counts] == [("took <NUM> ms", 2, 4)]
    assert [r["count"] for r in run(streams.bursts(streams.deduplicated(read()), late=None), "bursts")] in ([2], [])
    sink = streams.idempotent_sink(str(tmp_path / "out"))
    full = spark.createDataFrame([(r[0], r[1], r[2], "f", 1) for r in rows], "event_id string, case_id string, ts timestamp, source_file string, line_start int")
    sink(full, 0)
    sink(full, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streamed_episodes(spark, tmp_path):
    at = datetime(2026, 1, 1)
    schema = "case_id string, event_id string, ts timestamp, success boolean, denial boolean, normal boolean"
    row = lambda n, kind: ("c", f"e{n}", at + timedelta(minutes=n), kind == "s", kind == "d", kind == "n")
    rows = [row(n, k) for n, k in enumerate("sddsdnsnd")] + [("z", "last", at + timedelta(days=9), True, False, False)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(streams.denial_episodes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "episodes")
    assert [(r.denial_event_id, r.end_event_id, r.kind) for r in got][:2] == [("e1", "e4", "superseded"), ("e4", "e5", "recovered")]
