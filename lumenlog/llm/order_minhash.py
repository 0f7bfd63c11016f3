"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its occurrence-labelled shingles (five words; the n-th copy of a shingle is its n-th label).
Each of SKETCHES hash functions picks the TUPLE least labelled shingles, and their hashes in text order are one signature: two
documents agree on it if the same shingles are least and stand in the same order, so signatures feel edits that move text.

Similarity of two documents is shared / (all - shared) over labelled shingles, where shared counts those that an alignment
within a band matches in order. Documents with similarity `threshold` or more are linked, and classes are the connected
components. Documents with equal words are one node from the start.

A node whose signatures no other node has is alone in its class. Among the others, two that are linked have one of their rarest
shingles in common (prefix filter): with n and m shingles, no matter which, they need a = t / (1 + t) (n + m) in common, so the
first common one in any order stands before place n - a in one and before m - a in the other. Rarest first is that order, so
shared passages form no buckets unless they make up nearly all of a document. A bucket's documents are aligned with the one
that stands in the most and largest buckets, then with a few such, and what links have not joined by then with all others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._kernels import U, mix, rolling, word_hashes
from ._runtime import cut, doc_key, fitted, lean_heap, slices
from ._sketch import member_test

SHINGLE, SKETCHES, TUPLE = 5, 16, 3
_SEEDS = mix(np.arange(SKETCHES, dtype=U), 20)
#: Pairs with one center that a task gets together.
_SALT_ROWS = 500
#: Centers of a bucket in the first rounds; the last round takes all documents that are not in the bucket's largest class.
_CENTERS = (1, 8)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the labelled shingles in text order; a text shorter than a shingle is one shingle, an empty one has none."""
    if not len(words):
        return np.empty(0, dtype=U)
    grams = mix(rolling(words, size) if len(words) >= size else rolling(words, len(words)) + U(len(words)), 21)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return grams
    start = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    copy = np.empty(len(grams), dtype=U)
    copy[order] = (np.arange(len(ranked)) - start).astype(U)
    return np.where(copy > 0, mix(grams + copy * U(0x9E3779B97F4A7C15), 22), grams)


def signatures(labelled: np.ndarray) -> np.ndarray:
    """The SKETCHES signatures of a document's labelled shingles."""
    n = len(labelled)
    if not n:
        return np.empty(0, dtype=U)
    k = min(TUPLE, n)
    rows = max(1, min(SKETCHES, (1 << 20) // n))  # hash functions at once: a long document takes them in turns
    parts = []
    for first in range(0, SKETCHES, rows):
        hashed = mix(labelled[None, :] ^ _SEEDS[first : first + rows, None], 200)
        at = np.argpartition(hashed, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(hashed), 1))
        at.sort(axis=1)
        parts.append(labelled[at])
    out = np.arange(SKETCHES, dtype=U)
    for column in np.concatenate(parts).T:
        out = mix(out ^ column, 23)
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Similarity by the longest in-order match of labelled shingles within the band that threshold leaves; 0 if it can't be reached."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = threshold / (1 + threshold) * (n + m)  # matches that give the threshold
    if min(n, m) < need - 1e-9:
        return 0.0
    band = n + m - 2 * need  # unmatched shingles in all: no match lies further from the diagonal
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= band + 1e-9]
    if len(j) < need - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        matches = len(j)
    else:
        tops: list[int] = []
        for x in j.tolist():
            at = bisect_left(tops, x)
            tops[at : at + 1] = [x]
        matches = len(tops)
    return matches / (n + m - matches)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        (words, other), offsets = word_hashes(_lower(batch.column("text")), 2)
        digests, sigs = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            place = mix(np.arange(b - a, dtype=U), 24)
            digests.append((int(mix(words[a:b] ^ place, 25).sum(dtype=U).view(np.int64)), int(mix(other[a:b] + place, 26).sum(dtype=U).view(np.int64))))
            sigs.append(signatures(shingles(words[a:b])).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), batch.column("h"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "key", "h", "d1", "d2", "sigs"]
        )


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        (words,), offsets = word_hashes(_lower(batch.column("text")), 1)
        packed = [(words[a:b] >> U(32)).astype("<u4").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(packed, pa.binary())], names=["key", "h", "words"])


def _unpacked(words: bytes) -> np.ndarray:
    return shingles(mix(np.frombuffer(words, dtype="<u4").astype(U), 27))


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, np.ndarray] = (b"", np.empty(0, dtype=U))
        with lean_heap():
            for batch in batches:
                ok = []
                for a, b in zip(batch.column("words").to_pylist(), batch.column("center_words").to_pylist(), strict=True):
                    if held[0] != b:
                        held = (b, _unpacked(b))
                    ok.append(aligned(_unpacked(a), held[1], threshold) >= threshold - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("center"), pa.array(ok)], names=["doc", "center", "ok"])

    return run


def _verify(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(doc, center, ok) of distinct pairs. A center with many pairs is sent to as many tasks as its pairs need."""
    sizes = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / _SALT_ROWS).cast("int"))
    salted = pairs.join(sizes.select("center", "salts"), "center").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    centers = sizes.join(words.select(F.col("doc").alias("center"), F.col("words").alias("center_words")), "center").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rows = salted.drop("salts").join(words, "doc").join(centers.select("center", "salt", "center_words"), ["center", "salt"])
    return rows.select("doc", "center", "words", "center_words").mapInArrow(_verifier(threshold), "doc long, center long, ok boolean")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc, root): the smallest member of the connected component of each linked document, by alternating stars.

    Each round points every node at the least of its neighbours, then of its smaller neighbours; it ends when nothing changes.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), in_loop=True)
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        edges = fitted(edges, now[0])
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = fitted(both, 2 * now[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = cut(small.select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), in_loop=True)


def _candidates(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, key, h) of the nodes that share a signature with another node."""
    # Equal words have equal signatures, so the smallest row of each node can speak for it.
    speakers = scanned.join(nodes, ["d1", "d2"]).where("key = rep and h = rep_h").select("doc", "sigs")
    buckets = speakers.select("doc", F.explode("sigs").alias("bucket"))
    # Tables of shared keys are cut: next to a table, Spark can split the rows of a key that many have.
    shared = cut(buckets.groupBy("bucket").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("bucket"))
    wanted = buckets.join(shared, "bucket", "left_semi").select("doc").distinct()
    return cut(nodes.join(wanted, "doc", "left_semi").select("doc", F.col("rep").alias("key"), F.col("rep_h").alias("h")))


def _words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, words) of the wanted nodes; texts of other documents do not leave their scan."""
    maybe = member_test(wanted.select(F.xxhash64("key", "h")))
    texts = docs.where(maybe(F.xxhash64("key", "h"))).mapInArrow(_word_rows, "key long, h long, words binary")
    return cut(texts.join(wanted, ["key", "h"]).select("doc", "words").dropDuplicates(["doc"]))


def _prefixes(words: DataFrame, threshold: float) -> DataFrame:
    """(bucket, doc, size, most, weight): the rarest shingles of each node that others have too.

    A node links by the shingle `bucket` only to nodes of up to `most` shingles. weight: the sum of the node's bucket sizes.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_heap():
            for batch in batches:
                for doc, packed in zip(batch.column("doc").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    own = _unpacked(packed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), doc)), pa.array(np.full(len(own), len(own), dtype=np.int32)), pa.array(own)], names=["doc", "size", "shingle"])

    rows = words.mapInArrow(split, "doc long, size int, shingle long")
    common = cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Shingles of one document only come first in the order and match nothing: only their number matters.
    shared = rows.join(common, "shingle").groupBy("doc", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("own"))
    alone = F.col("size") - F.size("own")
    prefix = F.floor((1 - threshold) * F.col("size") + 1e-9).cast("int") + 1 - alone
    listed = shared.withColumn("prefix", prefix).where("prefix > 0").select("doc", "size", alone.alias("alone"), F.posexplode(F.expr("slice(own, 1, prefix)")).alias("place", "s"))
    after = F.col("size") - F.col("alone") - F.col("place")  # shingles from this one on
    entries = cut(listed.select(F.col("s.shingle").alias("bucket"), "doc", "size", (after * ((1 + threshold) / threshold) - F.col("size") + 1e-6).alias("most")))
    sizes = cut(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    entries = entries.join(sizes, "bucket")
    weights = entries.groupBy("doc").agg(F.sum("n").alias("weight"))
    return cut(entries.drop("n").join(weights, "doc").withColumn("root", F.col("doc")))


def _round(entries: DataFrame, words: DataFrame, tried: DataFrame | None, centers: int | None, threshold: float) -> DataFrame:
    """(doc, center, ok) of pairs of one bucket that no link joins yet; entries have the root of each node's class.

    centers: how many of the weightiest members of each bucket are aligned with the others; None: all members that are not in the bucket's largest class.
    """
    if centers is None:
        classes = entries.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        main = classes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main")).select("bucket", F.col("main.root").alias("main"))
        chosen = entries.join(main, "bucket").where("root <> main")
    else:
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), "doc"))
        chosen = entries.withColumn("place", place).where(F.col("place") <= centers)
    chosen = chosen.select("bucket", F.col("doc").alias("center"), F.col("size").alias("center_size"), F.col("most").alias("center_most"), F.col("root").alias("center_root"))
    possible = (F.col("root") != F.col("center_root")) & (F.col("size") <= F.col("center_most")) & (F.col("center_size") <= F.col("most"))
    a, b = F.greatest("doc", "center"), F.least("doc", "center")
    pairs = entries.join(chosen, "bucket").where(possible).select(a.alias("doc"), b.alias("center")).distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["doc", "center"], "left_anti")
    pairs = cut(pairs, in_loop=True)
    checked = cut(_verify(fitted(pairs, pairs.count()), words, threshold), in_loop=True)
    return fitted(checked, checked.count())


def _roots(entries: DataFrame, words: DataFrame, threshold: float) -> DataFrame | None:
    """(doc, root) of the nodes that links join to others; a root is the smallest node of its class. None without any."""
    found, tried = None, None
    for centers in (*_CENTERS, None):
        open_buckets = cut(entries.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket"), in_loop=True)
        entries = cut(entries.join(open_buckets, "bucket", "left_semi"), in_loop=True)
        left = entries.count()
        if not left:
            break
        entries = fitted(entries, left)
        checked = _round(entries, words, tried, centers, threshold)
        links = checked.where("ok").select("doc", "center")
        tried = checked if tried is None else cut(tried.unionByName(checked), in_loop=True)
        if found is not None:  # links between the classes so far
            for name in ("doc", "center"):
                other = "center" if name == "doc" else "doc"
                known = found.select(F.col("doc").alias("_member"), "root")
                links = links.join(known, F.col(name) == F.col("_member"), "left").select(F.coalesce("root", name).alias(name), other)
        joined = components(links, "doc", "center").select(F.col("doc").alias("_before"), F.col("root").alias("_after"))
        new = joined.select(F.col("_before").alias("doc"), F.col("_after").alias("root"))
        if found is not None:
            moved = found.join(joined, F.col("root") == F.col("_before"), "left").select("doc", F.coalesce("_after", "root").alias("root"))
            new = cut(moved.unionByName(new.join(found, "doc", "left_anti")), in_loop=True)
        found = fitted(new, new.count())
        entries = entries.join(joined, F.col("root") == F.col("_before"), "left").withColumn("root", F.coalesce("_after", "root")).drop("_before", "_after")
    return found


def _classified(documents: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, key, h, class_id, rep_id, kept) of each row; h hashes the text, kept: the row that stands for its class.

    A node ("doc" in links and buckets) is a group of rows with equal words. Nodes are numbered in the order of their smallest
    (key, h), so rows that share an id but not their words are different nodes, and the least node has the least id.
    """
    docs = documents.select(F.col(id_col).alias("id"), doc_key(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    scanned = cut(docs.mapInArrow(_scan, f"id {documents.schema[id_col].dataType.simpleString()}, key long, h long, d1 long, d2 long, sigs array<long>"))
    nodes = scanned.groupBy("d1", "d2").agg(F.min(F.struct("key", "h")).alias("least")).select("d1", "d2", F.col("least.key").alias("rep"), F.col("least.h").alias("rep_h"))
    nodes = cut(nodes.orderBy("rep", "rep_h", "d1", "d2").withColumn("doc", F.monotonically_increasing_id()))
    words = _words_of(docs.select("key", "h", "text"), _candidates(scanned, nodes))
    roots = _roots(_prefixes(words, threshold), words, threshold)
    if roots is None:
        classes = nodes.select("d1", "d2", "rep", "rep_h", F.col("rep").alias("class_id"), F.lit(True).alias("first"))
    else:
        linked = roots.join(nodes.select(F.col("doc").alias("root"), F.col("rep").alias("class_id")), "root")
        classes = nodes.join(linked, "doc", "left").select("d1", "d2", "rep", "rep_h", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce(F.col("root") == F.col("doc"), F.lit(True)).alias("first"))
    rows = scanned.select("id", "key", "h", "d1", "d2").join(classes, ["d1", "d2"])
    return rows.select("id", "key", "h", "class_id", F.col("rep").alias("rep_id"), (F.col("first") & (F.col("key") == F.col("rep")) & (F.col("h") == F.col("rep_h"))).alias("kept"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Classes of near-duplicate documents; one row for each input row.

    Returns id_col, class_id (the smallest id in the class) and rep_id (the smallest id with the same words). Words are the
    lower-case runs of characters other than ASCII white space. Texts
    shorter than five words are one shingle; null and empty texts have the same (no) words and are one class. Null ids share the
    largest value as class member. Rows that share an id but not their text are documents of their own, whose classes may have
    the same class_id; repeated rows get equal results. An empty table gives an empty table.
    """
    return _classified(documents, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "rep_id")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of each class of near_duplicates, the one with the smallest id; all columns stay.

    Rows are told apart by id and text; rows equal in both stay or go together. Rows that no class drops pass straight through.
    """
    dropped = cut(_classified(documents, id_col, text_col, threshold).where("not kept").select(F.col("key").alias("_lumenlog_a"), F.col("h").alias("_lumenlog_b")).distinct())
    key, h = doc_key(id_col), F.xxhash64(F.col(text_col).cast("string"))
    maybe = member_test(dropped.select(F.xxhash64("_lumenlog_a", "_lumenlog_b")))(F.xxhash64(key, h))
    suspects = documents.where(maybe)
    kept = suspects.join(dropped.hint("shuffle_hash"), (key == F.col("_lumenlog_a")) & (h == F.col("_lumenlog_b")), "left_anti")
    return documents.where(~maybe).unionByName(kept)


def brute_force(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, int]:
    """Classes by aligning every pair; for tests."""
    (words,), offsets = word_hashes(_lower(pa.array([t for _, t in rows], pa.large_string())), 1)
    own = [shingles(mix(words[a:b] >> U(32), 27)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    sets = [set(x.tolist()) for x in own]
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= threshold * (len(sets[i]) + len(sets[j]) - shared) - 1e-9 and aligned(own[i], own[j], threshold) >= threshold - 1e-9:
                a, b = find(i), find(j)
                if rows[a][0] <= rows[b][0]:
                    root[b] = a
                else:
                    root[a] = b
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
