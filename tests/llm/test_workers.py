"""What the corpus operators leave in Python workers, and how they use a worker's memory."""

import gc
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import _runtime, _sketch, bpe, queries, suffix_dedup
from lumenlog.llm._runtime import MAPPED, lean_executors, lean_heap, release, slices
from lumenlog.llm.substring_dedup import _distinct


def test_another_operators_task_drops_the_automaton(spark):
    documents = spark.createDataFrame([(n, f"some words {n}") for n in range(64)], "doc_id long, text string").repartition(8)
    assert bpe.encode_decode(documents, queries.tokenizer_path(), with_ids=False).where("n_tokens > 2").count() == 64

    def held(batches):
        for batch in slices(batches, "text"):
            automata = sum(type(x).__name__ == "Automaton" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([automata], pa.int64())], names=["automata"])

    assert {r.automata for r in documents.mapInArrow(held, "automata long").collect()} == {0}


FAULTS = """
import random, resource
import pyarrow as pa
from lumenlog.llm._kernels import anchors, byte_blocks
from lumenlog.llm._runtime import slices

rng = random.Random(1)
words = ["".join(rng.choices("etaoin shrdlu", k=7)) for _ in range(5000)]
texts = [" ".join(rng.choices(words, k=rng.randint(50, 400))) for _ in range(3000)]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for piece in slices(iter([batch]), "text"):
    for block, _ in byte_blocks(piece.column("text"), 100):
        anchors(block, 34, 50)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""


def test_a_task_uses_its_memory_again():
    done = subprocess.run([sys.executable, "-c", FAULTS], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 30_000  # pages for about 5 MB of text, block by block


def test_keys_stand_once_for_each_row():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (2, 1), (500, 50), (5000, 2**62)):
        rows, keys = rng.integers(0, 20, n), rng.integers(0, top, n).astype(np.uint64)
        assert sorted(_distinct(rows, keys).tolist()) == sorted(k for _, k in set(zip(rows.tolist(), keys.tolist(), strict=True)))


def test_suffix_dedup_keeps_what_a_scan_found(spark):
    """Each hashing of the texts reads them once more; every use of the positions and strings used to hash them again."""
    passage = "a passage of more than fifty bytes that several of these documents hold, "
    rows = [(n, f"{n} begins. " * 9 + (passage if n % 3 else "") + f"ends {n * 7919}. " * 9) for n in range(40)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    documents = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(documents)).collect()}
    assert got == suffix_dedup.brute_force(rows)
    assert read.value <= 10 * len(rows)


def test_packed_values_come_back_with_their_texts():
    doc, own = np.array([7, 8, 9]), np.array([70, 80, 90])
    batch = suffix_dedup._packed(np.array([0, 0, 2, 2, 2]), doc, own, h=np.arange(5, dtype=np.uint64) << np.uint64(60), at=np.arange(5, dtype=np.int32))
    for part, at in ((batch, [0, 1, 2, 3, 4]), (batch.slice(1), [2, 3, 4]), (batch.slice(0, 0), [])):
        got = suffix_dedup._unpacked(part, h="u8", at="i4")
        assert [x.tolist() for x in got] == [[7 if n < 2 else 9 for n in at], [70 if n < 2 else 90 for n in at], [n << 60 & 2**64 - 1 for n in at], at]


def _passages():
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdefgh ", k=rng.randint(40, 160))) for _ in range(12)]
    return [(n, "".join("".join(rng.choices("ijklmnop ", k=rng.randint(0, 40))) + rng.choice(shared)[rng.randint(0, 9) :] for _ in range(5))) for n in range(60)]


def test_suffix_dedup_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 5000)
    rows = _passages()
    seen = set()
    in_slice = suffix_dedup._in_slice
    names = np.arange(1000, dtype=np.int64)
    assert sum(in_slice(names, n, 4).astype(int) for n in range(4)).tolist() == [1] * 1000
    cut = suffix_dedup.cut
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, **k: (seen.add(tuple(df.columns)), cut(df, **k))[1])
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(documents)).collect()} == suffix_dedup.brute_force(rows)
    assert ("g", "c", "doc") in seen


def test_a_sketch_goes_before_the_positions_are_shuffled(spark, monkeypatch):
    """The bits of a sketch lie on the disks of the driver and of every executor."""
    done = []

    def repeated(*args, **kwargs):
        sketch, destroy = _sketch.repeated(*args, **kwargs), type(sketch_of).destroy
        monkeypatch.setattr(sketch, "destroy", lambda: (done.append("gone"), destroy(sketch)), raising=False)
        done.append("made")
        return sketch

    sketch_of = spark.sparkContext.broadcast(b"")
    cut = suffix_dedup.cut
    monkeypatch.setattr(suffix_dedup, "repeated", repeated)
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, **k: (cut(df, **k), done.append("cut"))[0])
    suffix_dedup.remove_repeated_bytes(spark.createDataFrame(_passages()[:9], "doc_id long, text string"))
    first = done.index("made")
    assert done[first : first + 3] == ["made", "cut", "gone"]


def test_a_sketchs_shuffles_go_with_it(spark):
    folders = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f.name for folder in folders for f in Path(folder).rglob("shuffle_*")}

    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    release(spark), time.sleep(1), release(spark), time.sleep(1)
    before = shuffles()
    _sketch.repeated(keys, _sketch._longs, 1 << 20).destroy()
    time.sleep(2)
    assert not shuffles() - before


def test_a_worker_unmaps_files_at_the_end_of_a_task(tmp_path):
    (tmp_path / "bits").write_bytes(b"\1" * 4096)
    with lean_heap():
        MAPPED["bits"] = np.memmap(tmp_path / "bits", dtype=np.uint8, mode="r")
    assert str(tmp_path / "bits") not in Path("/proc/self/maps").read_text()


def test_stages_after_the_dedups_begin_with_a_small_heap(spark):
    """A JVM gives heap back in a full collection only; in local mode the executor's is the driver's."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    documents = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    before = old.getCollectionCount()
    tokens = corpus_pipeline.tokens_stage(spark, documents, "")
    assert old.getCollectionCount() > before
    assert [(r.doc_id, r.n_tokens) for r in tokens.orderBy("doc_id").collect()] == [(1, 2), (2, 0)]


def test_suffix_dedup_gives_heap_back_between_its_steps(spark, monkeypatch):
    """In local mode the executor's JVM is the driver's, whose own collections are left out here."""
    for module in (_runtime, _sketch):
        monkeypatch.setattr(module, "release", lambda *args: None)
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    rows = _passages()[:20]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    before = old.getCollectionCount()
    result = suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(documents))
    steps = old.getCollectionCount() - before
    assert steps >= 8
    assert {r[0]: tuple(r[1:]) for r in result.collect()} == suffix_dedup.brute_force(rows)
    before = old.getCollectionCount()
    lean_executors(spark, once=True)
    assert old.getCollectionCount() == before + 1
