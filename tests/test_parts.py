"""Operators and helpers that SQL does not reach, against brute force and expectations written by hand."""

import itertools
import json
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog import config, models, store
from lumenlog.functions import text as T
from lumenlog.operators import events as ev
from lumenlog.operators import evaluation, knowledge, stacks, triage, vectors
from lumenlog.render import documents, tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


# Vectors


def brute_agglomerative(x, threshold):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), m, n) for (m, a), (n, b) in itertools.combinations(enumerate(groups), 2)), key=lambda t: t[0])
        if best[0] > threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def partition(labels):
    out = {}
    for n, label in enumerate(labels):
        out.setdefault(("noise", n) if label < 0 else label, set()).add(n)
    return {frozenset(g) for g in out.values()}


def test_agglomerative_equals_merging_the_nearest_groups():
    for seed in range(8):
        x = np.random.default_rng(seed).normal(size=(24, 3))
        assert partition(vectors.agglomerative(x, 0.3)) == brute_agglomerative(x, 0.3)
    assert partition(vectors.agglomerative(np.ones((5, 2)))) == {frozenset(range(5))}


def test_hdbscan_finds_separate_clumps_and_noise():
    rng = np.random.default_rng(1)
    clumps = [rng.normal(c, 0.05, size=(12, 2)) for c in ((0, 0), (5, 0), (0, 5))]
    labels = vectors.hdbscan(np.vstack([*clumps, [[50.0, 50.0]]]))
    for k in range(3):
        own = labels[12 * k : 12 * k + 12]
        assert len({x for x in own if x >= 0}) >= 1
    groups = partition(labels)
    assert not any({n // 12 for n in g if n < 36} - {min(g) // 12} for g in groups if min(g) < 36)
    assert (vectors.hdbscan(np.zeros((1, 2))) == -1).all()


def test_deep_trees_need_no_recursion():
    nested = (np.repeat(1.05 ** np.arange(1300), 2) + np.tile([0.0, 1e-3], 1300)).reshape(-1, 1)
    assert len(vectors.hdbscan(nested)) == len(nested)


def brute_tree(x):
    edges = sorted((float(np.sqrt(((x[a] - x[b]) ** 2).sum())), a, b) for a in range(len(x)) for b in range(a + 1, len(x)))
    group, out = list(range(len(x))), []
    for d, a, b in edges:
        if group[a] != group[b]:
            group, out = [group[a] if g == group[b] else g for g in group], [*out, (d, a, b)]
    return out


@pytest.mark.parametrize("grid", [False, True])
def test_forests_of_blocks_hold_the_tree_of_all(grid):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (90, 3)).astype(float) if grid else rng.normal(size=(90, 4))
    want, low, high = brute_tree(x), np.arange(40), np.arange(40, 90)
    assert sorted(zip(*(e.tolist() for e in vectors.forest(x)), strict=True)) == want
    parts = [vectors.forest(x[low]), vectors.forest(x[high], None, high), vectors.forest(x[low], x[high], low, high)]
    d, a, b = (np.concatenate(e) for e in zip(*parts, strict=True))
    tree = vectors.spanning(d, a, b)
    assert sorted(d[tree].tolist()) == [e[0] for e in want]
    assert partition(vectors.condensed(90, d[tree], a[tree], b[tree])) == partition(vectors.hdbscan(x))


def many(spark):
    """20,100 vectors of one case, copies of 300."""
    entry = lambda i: F.pmod(F.xxhash64(F.col("vec_id") % 300, i), F.lit(1000)) / 1000.0 - 0.5
    return spark.range(20_100).select(F.lit("c").alias("case_id"), F.col("id").alias("vec_id")).withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(63)), entry))


def test_a_case_may_have_any_number_of_vectors(spark):
    for method in ("hdbscan", "agglomerative"):
        assert vectors.cluster(many(spark), method).where("cluster_id = vec_id % 300").count() == 20_100


def test_average_linkage_by_components_equals_that_of_all(spark):
    x = np.random.default_rng(6).normal(size=(150, 3))
    rows = [("c", n, v.tolist()) for n, v in enumerate(x)] + [("c", 150 + n, [0.0] * 3) for n in range(2)]
    got = vectors.cluster(spark.createDataFrame(rows, "case_id string, vec_id long, embedding array<double>"), "agglomerative").orderBy("vec_id").collect()
    assert partition([r.cluster_id for r in got[:150]]) == brute_agglomerative(x, 0.3)
    assert len({r.cluster_id for r in got}) == len({r.cluster_id for r in got[:150]}) + 2


def test_cluster_ids_follow_first_appearance(spark):
    rows = [("c", n, [1.0, 0.0] if n % 2 else [0.0, 1.0]) for n in range(6)] + [("d", 9, [1.0, 0.0])]
    got = {(r.case_id, r.vec_id): r.cluster_id for r in vectors.cluster(spark.createDataFrame(rows, "case_id string, vec_id long, embedding array<double>"), "agglomerative").collect()}
    assert got == {("c", n): n % 2 for n in range(6)} | {("d", 9): 0}


# Texts


def test_text_helpers(spark):
    assert one(spark, T.sanitise(F.col("t")), t="a\x00b\x1bc‮d\n\te") == "abcd\n\te"
    assert one(spark, T.markdown_safe(F.col("t")), t="a*b<c>\n|d&") == "a\\*b&lt;c&gt; \\|d&amp;"
    assert one(spark, T.cut_bytes(F.col("t"), 5), t="aéé€") == "aéé" and one(spark, T.cut_bytes(F.col("t"), 6), t="aéé€") == "aéé" and one(spark, T.cut_bytes(F.col("t"), 9), t="aéé€") == "aéé€"
    numbers = {"1": 1.0, " 2.5e1 ": 25.0, ".5": 0.5, "nan": None, "inf": None, "-Infinity": None, "1d": None, "": None, "x": None, "1e400": None}
    assert {k: one(spark, T.finite_number(F.col("t")), t=k) for k in numbers} == numbers
    assert one(spark, T.bad_cells(F.array(*map(F.lit, ["1", "", "nan", "x", "1d", "-2e3"])))) == [1, 3, 4]
    assert one(spark, T.string_list(F.col("t")), t='["a", "b"]') == ["a", "b"] and one(spark, T.string_list(F.col("t")), t="plain") == ["plain"]
    assert one(spark, T.string_map(F.col("t")), t='{"a": 1}') == {"a": "1"} and one(spark, T.string_map(F.col("t")), t="[1]") == {"value": "[1]"}
    assert one(spark, T.sampling_note(F.lit(3), F.lit(12345))) == "(3 of 12,345 thread events cited as exemplars)"
    moments = {"2026-01-02T03:04:05,25Z": 250000, "2026-01-02": 0, "2026-13-02": None, "soon": None}
    assert {k: (v.microsecond if (v := one(spark, T.iso_moment(F.col("t")), t=k)) else None) for k in moments} == moments


def test_syslog_years(spark):
    at = lambda text: one(spark, T.syslog_moment(F.col("t"), F.col("m").cast("timestamp")), t=text, m="2026-01-05 00:00:00")
    assert at("Jan  3 01:02:03 x").year == 2026 and at("Dec 31 23:00:00 x").year == 2025 and at("Feb 30 01:00:00 x") is None and at("Xxx 3 01:02:03 y") is None


def test_frames(spark):
    raw = "TID 1:\n#0  0x1 boost::run@@V1 - l.so x.c:1\n#1  0x2 ??\n #2  0x3 indented\n#3  0x4 App::go(int) - a b:2\n#4  0x5 main\n"
    frames = one(spark, T.frames_of(F.col("t")), t=raw)
    assert frames == ["boost::run", "??", "App::go(int)", "main"]
    rows = spark.createDataFrame([(frames, i) for i in range(4)], "f array<string>, i int")
    assert [r.x for r in rows.select(T.enclosing_frame(F.col("f"), F.col("i")).alias("x")).collect()] == ["App::go(int)", "App::go(int)", None, None]


# Filters and rows


def test_filter_specs():
    assert ev.parse_filters(["file=a=b", "limit=3"], ev.EVENT_FILTERS) == {"file": "a=b", "limit": "3"}
    for bad in (["x=1"], ["file"], ["file=1", "file=2"], ["limit=-1"], ["since=soon"]):
        with pytest.raises(ValueError):
            ev.parse_filters(bad, ev.EVENT_FILTERS)
    assert ev.parse_moment("2026-01-02T03:00:00").tzinfo == timezone.utc and ev.parse_moment("2026-01-02T03:00:00+02:00").hour == 1


def test_of_repeated_rows_the_first_in_order_stays(spark):
    schema = "case_id string, event_id string, ts timestamp, source_file string, line_start int, message string"
    at = datetime(2026, 1, 1)
    rows = [("c", "a", None, "f", 1, "late"), ("c", "a", at, "g", 1, "second"), ("c", "a", at, "f", 9, "first"), ("c", "b", at, "f", 1, "known")]
    got = ev.new_events(spark.createDataFrame([rows[3]], schema), spark.createDataFrame(rows, schema)).collect()
    assert [r.message for r in got] == ["first"]
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "b"), (2, "a"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, ev.upsert(old, new, ["k"]).collect())) == [(1, "x"), (2, "a"), (3, "c")]


# Rules


def test_rules_files():
    text = '[meta]\nversion = 1\nvalidated_against = "x"\n[[rule]]\nrole = "running"\nsubsystem = "s"\nmatch = "contains"\npattern = "f"\n[[rule]]\nrole = "idle-parked"\nsubsystem = "t"\npattern = "g"\n'
    assert [(r.role, r.match, r.pattern) for r in stacks.parse_rules(text)] == [("running", "contains", "f"), ("idle-parked", "exact", "g")]
    for bad in (text.replace('"f"', '"f@@V"'), text.replace('"f"', '" "'), text + '[[rule]]\nrole = "running"\nsubsystem = "s"\nmatch = "contains"\npattern = "f"\n', text.replace("running", "jogging"), text.replace("subsystem", "system"), "x = 1"):
        with pytest.raises(ValueError):
            stacks.parse_rules(bad)


# Knowledge


def test_chunks_hold_all_text_in_order_within_the_cap():
    rng = random.Random(4)
    for _ in range(50):
        paragraphs = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))).strip() for _ in range(rng.randint(0, 12))]
        chunks = knowledge.chunks_of("\n\n".join(paragraphs), cap=40)
        assert all(0 < len(c) <= 40 for c in chunks)
        assert "".join(chunks).replace("\n\n", "") == "".join(p for p in paragraphs if p)


def test_knowledge_is_found_by_words(spark, tmp_path):
    (tmp_path / "a.md").write_text("disk full on volume\n\n" + "y " * 600)
    (tmp_path / "b.md").write_bytes(b"network down \xff")
    (tmp_path / "c.txt").write_text("left out")
    embed = models.embedder()
    chunks, vecs = knowledge.index(knowledge.read_markdown(spark, str(tmp_path)), embed, "case")
    assert {r.source_file for r in chunks.collect()} == {"a.md", "b.md"}
    found = knowledge.retrieve(chunks, vecs, spark.createDataFrame([("disk full",)], "text string"), embed, 1).collect()
    assert found[0].text.startswith("disk full") and knowledge.retrieve(chunks, vecs, spark.createDataFrame([], "text string"), embed).count() == 0


# Triage


ANSWER = {"hypotheses": [{"title": "t", "narrative": "n", "confidence": "low", "confidence_reasoning": "r", "supporting_event_ids": ["a1"], "contradicting_evidence": None, "suggested_next_steps": ["s"]}], "timeline_summary": "x", "unexplained_signals": []}


def replies(*texts):
    left = list(texts)
    asked = []

    def chat(messages):
        asked.append(messages)
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return chat, asked


def test_the_state_machine():
    good, other = json.dumps(ANSWER), json.dumps(ANSWER).replace("a1", "zz")
    cases = {
        (good,): (False, False, 1), ("junk", good): (False, False, 2), ("junk", "junk"): (True, False, 2), (other, good): (False, False, 2), (other, other): (True, False, 2), (other, "junk"): (True, False, 2), (OSError("down"),): (False, True, 1), (ValueError("empty"),): (False, True, 1),
    }
    for texts, (degraded, failed, calls) in cases.items():
        chat, asked = replies(*texts)
        got = triage.ask(chat, "p", {"a1"})
        assert (got.degraded, got.failed, len(asked)) == (degraded, failed, calls), texts
    assert triage.validate(good.replace('"low"', '"sure"'))[0] is None and triage.validate(json.dumps(ANSWER | {"more": 1}))[0] is None


def test_the_prompt_shows_what_may_be_cited():
    prompt, ids = triage.assemble([("a1", "boom")], {"MCM": ("facts [evt:b2]", {"b2"})}, ["know\x07ledge"], "look here")
    assert ids == {"a1", "b2"} and "[evt:a1] boom" in prompt and "facts [evt:b2]" in prompt and "knowledge" in prompt and "look here" in prompt and "<<" not in prompt
    assert "Reference material" not in triage.assemble([], {}, [], None)[0]
    assert triage.context_of(None, 4096) == 4096 and triage.context_of(0, None) == 8192 and triage.context_of(100, 4096) == 100


# Models and settings


def test_batches_keep_order_and_bounds():
    texts = ["aa", "b" * 20, "c", "dd", "e", "f"]
    assert models.packed(texts, 5, 2) == [["aa"], ["b" * 20], ["c", "dd"], ["e", "f"]]
    assert models.by_index([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1]}], 2) == [[1.0], [2.0]]
    for bad in ([{"index": 0, "embedding": [float("nan")]}], [{"index": 0, "embedding": []}], [{"index": 1, "embedding": [1.0]}], "x"):
        with pytest.raises(ValueError):
            models.by_index(bad, 1)
    for url in ("http://localhost:1/v1", "http://a.localhost", "http://10.0.0.1", "http://[::1]:2"):
        models.require_local(url)
    for url in ("http://example.org", "http://8.8.8.8"):
        with pytest.raises(ValueError):
            models.require_local(url)
    assert len(models.determinism_warnings({"n_parallel": 4, "default_generation_settings": {"params": {"seed": -1, "temperature": 0.7}}})) == 3 and not models.determinism_warnings({"n_parallel": True})


def test_settings_in_layers(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('data_dir = "/a"\n[generation]\nmodel = "file"\ntimeout = 5\n[mcm.thresholds.working_set_pct_virtual]\nwarn = 1\ncritical = 2\n')
    got = config.load(str(path), {"generation": {"retries": 7, "model": None}}, {"LUMENLOG_GENERATION_MODEL": "env", "LUMENLOG_EMBEDDINGS_BATCH_SIZE": "9"})
    assert (got.data_dir, got.generation.model, got.generation.timeout, got.generation.retries, got.embeddings.batch_size) == ("/a", "env", 5, 7, 9)
    assert got.mcm.thresholds == {"working_set_pct_virtual": (1.0, 2.0)}
    for bad in ({"nothing": 1}, {"timezones": {"*": "Moon/Base"}}, {"clustering": {"method": "x"}}):
        with pytest.raises(ValueError):
            config.load(None, bad, {})


# Evaluation files


def test_floors_and_truth(tmp_path):
    floors, truth = tmp_path / "f.toml", tmp_path / "t.yaml"
    floors.write_text("".join(f"{m} = 0.5\n" for m in evaluation.METRICS))
    assert evaluation.read_floors(str(floors))["hypothesis_hit_at_k"] == 0.5
    floors.write_text("hypothesis_hit_at_k = 1\n")
    with pytest.raises(ValueError):
        evaluation.read_floors(str(floors))
    truth.write_text(json.dumps({"root_cause": "x", "expect_eustack": {"provenance": "authored", "hang_detected": True, "total_threads": 3, "pools": {"a": 1}}}))
    assert evaluation.read_truth(str(truth)).expect_eustack.pools == {"a": 1}
    truth.write_text(json.dumps({"root_cause": "x", "typo": 1}))
    with pytest.raises(ValueError):
        evaluation.read_truth(str(truth))


# Rendering


def test_rendering_helpers(tmp_path, spark):
    assert documents.fenced("a ``` b")[0] == "````" and documents.safe("a|b\n<c>") == "a\\|b &lt;c&gt;"
    document = {"run": {"generated_at": 1, "model": "m"}, "file_path": "/abs", "rel_path": "x/y", "text": "/kept", "elapsed_s": 3, "rows": [{"dir": "/q", "n": 1}]}
    assert documents.normalised(document) == {"run": {"model": "m"}, "rel_path": "x/y", "text": "/kept", "rows": [{"n": 1}]}
    assert documents.linked("[evt:ab] [evt:cd]", {"ab"}) == "[ab](#evt-ab) cd"
    tables.write_csv(spark.createDataFrame([("a,b", None), ('q"', 1)], "x string, y int").orderBy("x"), str(tmp_path / "t"))
    text = next((tmp_path / "t").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["x,y", '"a,b",', '"q""",1'] or text.splitlines()[0] == "x,y"


def test_targets():
    assert store.parse_target("cluster:007") == ("cluster", "7") and store.parse_target("template:0a") == ("template", "0a")
    for bad in ("7", "cluster:", "cluster:x", "event:1"):
        with pytest.raises(store.VerdictError):
            store.parse_target(bad)
