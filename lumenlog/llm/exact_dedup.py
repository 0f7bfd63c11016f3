"""Exact deduplication of documents by two-pass Bloom filtering.

One scan reduces each text to a digest and a length, kept in the shared checkpoint folder. Pass 1 merges partition filters
that remember which digests may have been seen twice (see `_sketch`; they never miss one). Pass 2 sends only the rows with
such a digest through a shuffle, where equal digests are grouped exactly; all other rows pass straight through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import cut, slices
from ._sketch import cells_for, may_repeat, member_test, repeated

_WHITE = b" \t\n\x0b\x0c\r"
_ROWS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        digests = [hashlib.sha256((t or "").encode().translate(None, _WHITE)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(digests, pa.binary())], schema=_ROWS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.frombuffer(b"".join(d[:8] for d in batch.column("digest").to_pylist()), dtype=np.uint64)


def _grouped(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, keep_id, group_size, kept, twin, digest) of each row; h hashes the text, twin: dropped, but equal to the row that stays."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    # The checkpoint fixes the row numbers, which settle which of several fully equal rows stays.
    rows = cut(docs.mapInArrow(_digests, "id long, h long, n long, digest binary").withColumn("row", F.monotonically_increasing_id()))
    cells = cells_for(rows.count(), 8)
    seen = repeated(rows.select("digest"), _keys, cells)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in _keys(iter([batch])):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may_repeat(seen, keys, cells))], names=[*batch.schema.names, "again"])

    marked = cut(rows.mapInArrow(flagged, "id long, h long, n long, digest binary, row long, again boolean"))
    alone = marked.where("not again").select("id", "h", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(False).alias("twin"), "digest")
    order = F.struct(F.col("n").alias("n"), F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("id"), F.col("h").alias("h"), (-F.col("row")).alias("row"))
    again = marked.where("again")
    # One row for each digest; a table of its own, so that Spark can split the rows of a digest that many have.
    best = cut(again.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(order).alias("best")).select("digest", "group_size", (-F.col("best.id")).alias("keep_id"), F.col("best.h").alias("keep_h"), (-F.col("best.row")).alias("keep_row")))
    kept = F.col("row") == F.col("keep_row")
    twin = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")) & ~kept
    return alone.unionByName(again.join(best, "digest").select("id", "h", "keep_id", "group_size", kept.alias("kept"), twin.alias("twin"), "digest"))


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal without their ASCII white space; one row for each input row.

    Returns id_col, keep_id, group_size, kept and text_sha256 (of the text without white space). The row with the most code
    points in the original text, then the smallest id, stays. Null text is empty, and empty texts are one group. Null ids lose
    to all others; a group of null ids only has a null keep_id. Of rows that share an id and have equal texts one is kept. An
    empty table gives an empty table. Ids are longs.
    """
    return _grouped(documents, id_col, text_col).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the rows that exact_groups drops; all columns stay.

    Rows are told apart by id and text. Of rows equal in both, all but one go, in the order that Spark meets them. Rows that may
    go take part in a join; the rest, which a Bloom filter tells, pass straight through.
    """
    rows = _grouped(documents, id_col, text_col).where("not kept")
    gone = cut(rows.groupBy(F.col("id").alias("_lumenlog_a"), F.col("h").alias("_lumenlog_b")).agg(F.max("twin").alias("_lumenlog_twin")))
    key, h = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    maybe = member_test(gone.select(F.xxhash64("_lumenlog_a", "_lumenlog_b")))(F.xxhash64(key, h))
    held = documents.where(maybe).withColumn("_lumenlog_id", key).withColumn("_lumenlog_h", h)
    same = F.col("_lumenlog_id").eqNullSafe(F.col("_lumenlog_a")) & (F.col("_lumenlog_h") == F.col("_lumenlog_b"))
    marked = held.join(gone.hint("shuffle_hash"), same, "left")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    plain = marked.where("_lumenlog_twin is null").select(*columns)
    doubled = marked.where("_lumenlog_twin").dropDuplicates(["_lumenlog_id", "_lumenlog_h"]).select(*columns)
    return documents.where(~maybe).unionByName(plain).unionByName(doubled)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT doc_id, h, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w AS k
  FROM n WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""
