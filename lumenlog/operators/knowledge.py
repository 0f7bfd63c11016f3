"""Knowledge base: Markdown files in chunks with vectors; its chunks have no event ids, so they can never be cited."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import l2_normalise, mean_vector, nearest

#: Characters of a chunk, chunks shown.
CHUNK, TOP = 800, 5


def chunks_of(text: str, cap: int = CHUNK) -> list[str]:
    """Paragraphs packed in order into chunks of at most cap characters; a longer paragraph is cut every cap characters."""
    out: list[str] = []
    for paragraph in (p.strip() for p in text.replace("\r\n", "\n").split("\n\n")):
        if not paragraph:
            continue
        if out and len(paragraph) <= cap and len(out[-1]) + 2 + len(paragraph) <= cap:
            out[-1] += "\n\n" + paragraph
        else:
            out += [paragraph[at : at + cap] for at in range(0, len(paragraph), cap)]
    return out


def chunk_rows(texts: DataFrame, cap: int = CHUNK) -> DataFrame:
    """(source_file, position, text) of the chunks of (source_file, text) rows, in a narrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(f, n, c) for f, t in zip(frame["source_file"], frame["text"], strict=True) for n, c in enumerate(chunks_of(t or "", cap))]
            yield pd.DataFrame(rows, columns=["source_file", "position", "text"])

    return texts.select("source_file", "text").mapInPandas(run, "source_file string, position int, text string")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, text) of the *.md files below a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def index(texts: DataFrame, embed: Callable[[DataFrame], DataFrame], case_id: str, cap: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Chunks (case_id, chunk_id, source_file, text) and vectors (case_id, chunk_id, embedding); ids follow file and position."""
    rows = chunk_rows(texts, cap).withColumn("chunk_id", F.xxhash64("source_file", "position", "text")).withColumn("case_id", F.lit(case_id))
    vectors = l2_normalise(embed(rows.select("chunk_id", "text")))
    return rows.select("case_id", "chunk_id", "source_file", "text"), vectors.select(F.lit(case_id).alias("case_id"), "chunk_id", "embedding")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, embed: Callable[[DataFrame], DataFrame], k: int = TOP) -> DataFrame:
    """The k chunks nearest to the mean of the queries' vectors, nearest first; none without queries."""
    row = mean_vector(l2_normalise(embed(queries))).first()
    if row is None or not row.embedding:
        return chunks.limit(0).select("chunk_id", "text").withColumn("distance", F.lit(0.0))
    return nearest(vectors.select("chunk_id", "embedding"), row.embedding, k, "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "text", "distance").orderBy("distance", "chunk_id")
