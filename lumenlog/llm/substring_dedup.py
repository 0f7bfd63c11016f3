"""Removal of long passages that repeat across documents, with a count-min prefilter.

A window is `width` consecutive words of one document. Rows whose whole text has a smaller copy are set apart first
(`_copies`). Pass 1 counts, for each other document, the anchors of its windows (see `_kernels.anchors`) in a count-min sketch; a
window's anchor is counted at least as often as the window, so the merged partition sketches overestimate window counts. Pass 2
emits only the windows whose estimate is two or more, as 128-bit hashes, and groups them exactly: no repeated window is
lost. With grams of half a window about one position in fourteen is an anchor, so the sketch needs a fourteenth of the cells that
the windows would; with `gram` equal to `width` each window is its own anchor and the sketch counts windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._copies import Apart
from ._kernels import Block, anchors, rolling, word_blocks, word_hashes
from ._runtime import cut, slices
from ._sketch import cells_for, may_repeat, repeated

_WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("at", pa.int32())])


def _distinct(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One of each key of each row, in no order. Only keys that stand in several places are sorted with their rows."""
    ranked = np.sort(keys)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return keys
    several = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
    rows, once, keys = rows[several], keys[~several], keys[several]
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return np.concatenate([once, keys[new]])


def _windows_with(block: Block, chosen: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Starts, in the block, of the windows that hold the gram of a chosen anchor and that the block answers for."""
    n = len(block.values[0])
    edge = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(edge, np.maximum(chosen - (width - gram), 0), 1)
    np.add.at(edge, chosen + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    piece = block.piece_of(at)
    return at[(at >= block.low[piece]) & (at < block.high[piece]) & (at + width <= block.end[piece])]


def remove_repeated_windows(documents: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None) -> DataFrame:
    """Remove each word covered by a window whose words also start in a document with a smaller id.

    Words are the runs of characters other than ASCII white space. Returns id_col, text_col (the kept words joined by one
    space), n_words and n_removed, one row for each input row; other columns are left out. Null text has no words; texts
    shorter than a window keep all. Null ids count as the largest id. Rows that share an id are one document where ids are
    compared: a window never repeats within it; each row loses its own text's words only, and repeated rows get equal results. An empty table gives an empty table.
    """
    gram = gram or (width + 1) // 2
    halo = 2 * width
    apart = Apart(documents, id_col, text_col)
    docs, fresh = apart.searched, apart.batches()
    # A word and the space after it take about six bytes; an anchor stands for (width - gram + 2) / 2 words.
    cells = cells_for(int(apart.size() / 6 / ((width - gram + 2) / 2)) + 1)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in fresh(batches):
            doc = batch.column("doc").to_numpy()
            hashes, offsets = word_hashes(batch.column("text"), 1)
            for block in word_blocks(hashes, offsets, halo):
                chosen, keys = anchors(block, gram, width)
                yield _distinct(doc[block.row[block.piece_of(chosen)]], keys)

    sketch = repeated(docs, keys_of, cells)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch
        for batch in fresh(batches):
            doc, own = batch.column("doc").to_numpy(), batch.column("t").to_numpy()
            hashes, offsets = word_hashes(batch.column("text"), 2)
            for block in word_blocks(hashes, offsets, halo):
                # The anchor of a window that starts here may lie in the overlap with the next block.
                chosen, keys = anchors(block, gram, width, own=False)
                chosen = chosen[may_repeat(bits, keys, cells)]
                if len(chosen):
                    at = _windows_with(block, chosen, gram, width)
                    piece = block.piece_of(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rolling(block.values[0], width, 0)[at].view(np.int64)),
                            pa.array(rolling(block.values[1], width, 1)[at].view(np.int64)),
                            pa.array(doc[block.row[piece]]),
                            pa.array(own[block.row[piece]]),
                            pa.array((block.first[piece] + at - block.start[piece]).astype(np.int32)),
                        ],
                        schema=_WINDOWS,
                    )

    windows = docs.mapInArrow(candidates, "h1 long, h2 long, doc long, t long, at int")
    first = cut(windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last"))
    covered = windows.join(first, ["h1", "h2"]).where("doc > first").groupBy("doc", "t").agg(F.collect_list("at").alias("spans"))
    rows = apart.with_spans(cut(covered))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, n_words, n_removed = [], [], []
            for text, starts, copy in zip(batch.column("text").to_pylist(), batch.column("spans"), batch.column("copy").to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = 0
                if copy and len(words) >= width:
                    keep, gone = b"", len(words)
                elif starts.is_valid and words:
                    edge = np.zeros(len(words) + width + 1, dtype=np.int32)
                    at = np.unique(starts.values.to_numpy())
                    edge[at] += 1
                    edge[at + width] -= 1
                    stay = np.cumsum(edge[: len(words)]) == 0
                    gone = len(words) - int(stay.sum())
                    keep = b" ".join(words[i] for i in np.flatnonzero(stay).tolist())
                else:
                    keep = b" ".join(words)
                texts.append(keep.decode())
                n_words.append(len(words))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[id_col, text_col, "n_words", "n_removed"])

    kind = documents.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(kept, f"`{id_col}` {kind}, `{text_col}` string, n_words long, n_removed long")


def digest(result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of remove_repeated_windows with a hash of the kept text in its place."""
    return result.select(id_col, "n_words", "n_removed", F.sha2(F.col(text_col), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = 50) -> dict[int, tuple[int, int, str]]:
    """The same counts by looking at every window; for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    least: dict[tuple, int] = {}
    for i, w in words.items():
        for a in range(len(w) - width + 1):
            key = tuple(w[a : a + width])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in words.items():
        gone = {k for a in range(len(w) - width + 1) if least[tuple(w[a : a + width])] < i for k in range(a, a + width)}
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out
