"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors. So the order
of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has
two parts, both summed modulo a power of two:

* identity: 4 lanes modulo 2**64, a 256-bit cryptographic hash of the paragraph. Equal sums mean equal multisets.
* likeness: 256 lanes modulo 2**32. Each word, with the word after it in the paragraph, adds +1 or -1 to one lane, so the
  product of two documents' lanes estimates how many such pairs they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import BASES, U, mix, word_hashes
from ._runtime import NULL_ID, doc_key, shuffle_partitions

IDENTITY, LANES = 4, 256


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Identity (n x 4, uint64) and likeness (n x 256, int32) of texts; paragraphs are their non-empty lines."""
    identity = np.zeros((len(texts), IDENTITY), dtype=U)
    paragraphs, owner = [], []
    for n, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x]
        if lines:
            hashes = b"".join(hashlib.blake2b(x.encode(), digest_size=32).digest() for x in lines)
            identity[n] = np.frombuffer(hashes, dtype="<u8").reshape(-1, IDENTITY).sum(axis=0, dtype=U)
            paragraphs += lines
            owner += [n] * len(lines)
    likeness = np.zeros((len(texts), LANES), dtype=np.int32)
    if paragraphs:
        (words,), offsets = word_hashes(pa.array(paragraphs, pa.large_string()), 1)
        if len(words):
            following = np.zeros(len(words), dtype=U)
            following[:-1] = words[1:]
            following[offsets[1:][np.diff(offsets) > 0] - 1] = 0
            pairs = mix(words * BASES[0] + following, 50)
            doc = np.repeat(np.array(owner, dtype=np.int64), np.diff(offsets))
            lane = doc * LANES + (pairs >> U(56)).astype(np.int64)
            signs = np.where(pairs & U(1), 1.0, -1.0)
            sums = np.bincount(lane, weights=signs, minlength=len(texts) * LANES)
            likeness = sums.astype(np.int64).astype(np.int32).reshape(len(texts), LANES)
    return identity, likeness


def to_hex(identity: np.ndarray, likeness: np.ndarray) -> list[str]:
    return [a.astype("<u8").tobytes().hex() + b.astype("<i4").tobytes().hex() for a, b in zip(identity, likeness, strict=True)]


def from_hex(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * IDENTITY], dtype="<u8"), np.frombuffer(raw[8 * IDENTITY :], dtype="<i4")


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint with b's paragraphs inserted into a (sign 1) or deleted from it (sign -1)."""
    (x, y), (u, v) = from_hex(a), from_hex(b)
    return to_hex((x + u if sign > 0 else x - u)[None], (y + v if sign > 0 else y - v)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated share of common word pairs (shared / all of both), row by row: 1 for equal fingerprints, 0 to 1."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    both, own, other = (x * y).sum(axis=1), (x * x).sum(axis=1), (y * y).sum(axis=1)
    union = own + other - both
    out = np.clip(np.divide(both, union, out=np.zeros_like(both), where=union > 0), 0.0, 1.0)
    return np.where((a[0] == b[0]).all(axis=1), 1.0, out)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many first code points of the following text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the fingerprint of each document: a narrow scan without shuffle. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), pa.array(to_hex(*vectors(part)), pa.string())], names=[id_col, "fingerprint"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, tail, doc, h, id, text), sorted within partitions so that the next document follows each document.

    Documents go to ranges of ids. The first document of each range goes to the range before as well, marked as tail, and the
    first of all to the last range: one shuffle of the texts, no partition that grows with the table, and no window over it.
    """
    spark = documents.sparkSession
    docs = documents.select(doc_key(id_col).alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    parts = shuffle_partitions(spark)
    ranges = 4 * parts
    cuts = sorted(set(docs.approxQuantile("doc", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if not docs.isEmpty() else []
    # The number of cuts is bounded by the number of partitions.
    edges = np.array([min(int(x), NULL_ID) for x in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(doc: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, doc.to_numpy(), side="right").astype(np.int32))

    placed = docs.withColumn("bucket", bucket("doc"))
    firsts = sorted((r.bucket, r.least.doc, r.least.h) for r in placed.groupBy("bucket").agg(F.min(F.struct("doc", "h")).alias("least")).collect())
    before = [(doc, h, firsts[n - 1][0]) for n, (_, doc, h) in enumerate(firsts)]
    tails = F.broadcast(spark.createDataFrame(before, "doc long, h long, before int"))
    target = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("tail")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("b"), F.lit(True).alias("tail")))
    )
    out = placed.join(tails, ["doc", "h"], "left").withColumn("to", F.explode(target)).select(F.col("to.b").alias("bucket"), F.col("to.tail").alias("tail"), "doc", "h", "id", "text")
    return out.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc", "h")


def fingerprint_with_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text (see `edited`), and likenesses; one row for each input row.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The next document is
    the one after it by ascending id (rows that share an id: by a hash of their text), the first one after the last. Null text
    is empty; null ids come last. Two empty texts have likeness 1; an empty and a non-empty one 0. A table of one row has
    itself as next document; an empty table gives an empty table.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, tail, id, text)

        def flush() -> pa.RecordBatch | None:
            texts = [x[3] for x in held]
            own = vectors(texts)
            pairs = [n for n in range(len(held) - 1) if held[n][0] == held[n + 1][0] and not held[n][1]]
            if not pairs:
                return None
            changed = [edited(texts[n], texts[n + 1]) for n in pairs]
            other = vectors(changed)
            at = np.array(pairs)
            a, b = (own[0][at], own[1][at]), (own[0][at + 1], own[1][at + 1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[n][2] for n in pairs], kinds),
                    pa.array([len(texts[n]) for n in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                    pa.array(to_hex(*a), pa.string()),
                    pa.array(to_hex(*other), pa.string()),
                    pa.array(likeness(a, other)),
                    pa.array(likeness(a, b)),
                ],
                names=names,
            )

        kinds, size = None, 0
        for batch in batches:
            kinds = batch.schema.field("id").type
            columns = [batch.column(c) for c in ("bucket", "tail", "id", "text")]
            for at in range(0, batch.num_rows, 64):
                rows = zip(*(c.slice(at, 64).to_pylist() for c in columns), strict=True)
                for bucket, tail, key, text in rows:
                    held.append((bucket, tail, key, text or ""))
                    size += len(text or "")
                    if size > 1 << 19 or len(held) >= 512:
                        out = flush()
                        if out is not None:
                            yield out
                        held, size = held[-1:], 0
        if len(held) > 1:
            out = flush()
            if out is not None:
                yield out

    rows = with_next(documents, id_col, text_col).select("bucket", "tail", "id", "text")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
