"""Rows whose whole text stands in a document with a smaller id, set apart before passages are searched.

Such a row repeats all of its passages, so its windows need no search; and as the smallest copy stays in, no other row's result
depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import cut, doc_key, slices, small_batches
from ._sketch import longs_in, member_bits


class Apart:
    """A table's rows for a passage search: which ones to search, and all of them with what the search found.

    Rows are (doc, id, text, t, m): the never-null key of the id, and two hashes of the text; t tells rows apart that share an id.
    """

    def __init__(self, documents: DataFrame, id_col: str, text_col: str):
        small_batches(documents.sparkSession)
        text = F.col(text_col).cast("string")
        rows = documents.select(doc_key(id_col).alias("doc"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"), F.hash(text, F.octet_length(text)).alias("m"))
        self.rows = rows.withColumn("name", F.xxhash64("doc", "t", "m"))
        # Tables of their own, next to which Spark can split the rows of a text that many have.
        least = cut(rows.groupBy("t", "m").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").drop("last"))
        self.later = cut(rows.select("doc", "t", "m").join(least, ["t", "m"]).where("doc > least").select("doc", "t", "m").distinct())
        self._maybe_later = member_bits(self.later.select(F.xxhash64("doc", "t", "m")))
        maybe, bits, cells = _test(self._maybe_later), *self._maybe_later
        held = self.rows.where(maybe("name"))
        # The Bloom filter holds a few rows that are no copies; they are searched too.
        few = cut(held.join(self.later, ["doc", "t", "m"], "left_anti").select("doc", "t", "text", F.lit(0).cast("long").alias("name")))
        self.searched = self.rows.select("doc", "t", "text", "name").withColumn("sure", F.lit(False)).unionByName(few.withColumn("sure", F.lit(True)))
        self._bits, self._cells = bits, cells

    def size(self) -> int:
        """UTF-8 bytes of all texts."""
        return self.rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def batches(self):
        """A filter of `searched`'s batches in a worker: slices of the rows that are no later copies."""
        bits, cells = self._bits, self._cells

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                skip = longs_in(bits, cells, batch.column("name").to_numpy()) & ~batch.column("sure").to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(~skip))

        return lambda batches: slices(searched(batches), "text")

    def with_spans(self, spans: DataFrame) -> DataFrame:
        """(id, text, spans, copy) of all rows: the spans (doc, t, spans) of searched rows, and which rows are later copies.

        One test of each row tells whether it may be in either table; only those rows are shuffled.
        """
        later, found = self._maybe_later, member_bits(spans.select(F.xxhash64("doc", "t")))

        @F.pandas_udf("boolean")
        def concerned(name: pd.Series, short: pd.Series) -> pd.Series:
            return pd.Series(longs_in(later[0], later[1], name.to_numpy()) | longs_in(found[0], found[1], short.to_numpy()))

        rows = self.rows.withColumn("concerned", concerned("name", F.xxhash64("doc", "t")))
        kind = spans.schema["spans"].dataType
        plain = rows.where("not concerned").select("id", "text", F.lit(None).cast(kind).alias("spans"), F.lit(False).alias("copy"))
        marks = self.later.select("doc", "t", F.col("m").alias("copy_m")).dropDuplicates(["doc", "t"])
        held = rows.where("concerned").join(spans.hint("shuffle_hash"), ["doc", "t"], "left").join(marks.hint("shuffle_hash"), ["doc", "t"], "left")
        return plain.unionByName(held.select("id", "text", "spans", F.coalesce(F.col("m") == F.col("copy_m"), F.lit(False)).alias("copy")))


def _test(held):
    bits, cells = held

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(longs_in(bits, cells, key.to_numpy()))

    return test
