"""Count-min sketches with counters that stop at two, made by partitions and merged by Spark.

A sketch answers one question: may this 64-bit key have been counted twice or more? It overestimates and never
underestimates. Partitions send sorted cell numbers, cut into segments; segments merge in two shuffles, so no task
gets more than a segment from a share of the partitions. The merged sketch is one bit for each cell (counted twice or
more), between 2**20 and ROWS * MAX_CELLS bits whatever the input: 128 MB at most, the bound of the broadcast, of which the
workers of an executor map one copy. Past that
size the sketch only lets more candidates through; results stay exact.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._kernels import U, mix
from ._runtime import MAPPED, cut, lean_heap, release

#: Hash rows of a sketch; most cells in a row.
ROWS = 2
MAX_CELLS = 1 << 29
_SEGMENT = 1 << 16
_FLUSH = 4_000_000
#: Neighbouring partitions whose parts merge first.
_TOGETHER = 32

_PART = pa.schema([("segment", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def cells_for(keys: int, per_key: int = 4) -> int:
    """Cells of a row: a power of two, per_key times the expected keys at least, up to MAX_CELLS."""
    cells = 1 << 20
    while cells < per_key * keys and cells < MAX_CELLS:
        cells *= 2
    return cells


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    shift = U(64 - cells.bit_length() + 1)
    return [(mix(keys, 1000 + row) >> shift).astype(np.int64) + row * cells for row in range(ROWS)]


def _parts(keys: list[np.ndarray], cells: int, salt: int) -> Iterator[pa.RecordBatch]:
    for numbers in _cells(np.concatenate(keys), cells):
        numbers.sort()
        first = np.empty(len(numbers), dtype=bool)
        first[:1] = True
        first[1:] = numbers[1:] != numbers[:-1]
        again = np.zeros(len(numbers), dtype=bool)
        again[1:] = ~first[1:]
        rows: dict[int, list[bytes]] = {}
        for slot, chosen in ((0, numbers[first]), (1, np.unique(numbers[again]))):
            segments = chosen >> 16
            edges = np.flatnonzero(np.diff(segments, prepend=-1, append=-1))
            low = (chosen & (_SEGMENT - 1)).astype("<u2")
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows.setdefault(int(segments[a]), [b"", b""])[slot] = low[a:b].tobytes()
        names = list(rows)
        for at in range(0, len(names), 8192):
            part = names[at : at + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([salt] * len(part), pa.int32()), pa.array([rows[s][0] for s in part], pa.binary()), pa.array([rows[s][1] for s in part], pa.binary())], schema=_PART
            )


def _merged(once: list[bytes], more: list[bytes]) -> np.ndarray:
    counts = np.zeros(_SEGMENT, dtype=np.uint8)
    for part in once:
        at = np.frombuffer(part, dtype="<u2")
        counts[at] = np.minimum(counts[at] + 1, 2)
    for part in more:
        counts[np.frombuffer(part, dtype="<u2")] = 2
    return counts


def _merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with lean_heap():
        for batch in batches:
            once, more = [], []
            for a, b in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                counts = _merged(a, b)
                once.append(np.flatnonzero(counts).astype("<u2").tobytes())
                more.append(np.flatnonzero(counts == 2).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array([0] * batch.num_rows, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], schema=_PART)


_BITS = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])


def _bits_of(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_heap():
            for batch in batches:
                bits = [np.packbits(_merged(a, b) >= least, bitorder="little").tobytes() for a, b in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(bits, pa.binary())], schema=_BITS)

    return merge


def repeated(df: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int, least: int = 2) -> Broadcast:
    """The merged sketch of the keys that keys_of yields for df's partitions, as a broadcast bit array: cells counted `least` times or more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() // _TOGETHER
        held, count = [], 0
        with lean_heap():
            for keys in keys_of(batches):
                held.append(keys)
                count += len(keys)
                if count >= _FLUSH:
                    yield from _parts(held, cells, salt)
                    held, count = [], 0
            if count:
                yield from _parts(held, cells, salt)
            del held

    lists = (F.collect_list("once").alias("once"), F.collect_list("more").alias("more"))
    parts = df.mapInArrow(sketch, "segment int, salt int, once binary, more binary")
    level = parts.groupBy("segment", "salt").agg(*lists).select("segment", "salt", "once", "more").mapInArrow(_merge_parts, "segment int, salt int, once binary, more binary")
    done = level.groupBy("segment").agg(*lists).mapInArrow(_bits_of(least), "segment int, bits binary")
    whole = bytearray(ROWS * cells // 8)
    size = _SEGMENT // 8
    # The bits come in pieces of about 2 MB, a job for each.
    for row in done.coalesce(max(1, len(whole) >> 21)).toLocalIterator():
        whole[row.segment * size : (row.segment + 1) * size] = row.bits
    del parts, level, done
    release(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(whole)


def bits_of(sketch: Broadcast) -> np.ndarray:
    """The sketch's bits in a worker: mapped from the broadcast's file, so that an executor's workers share one copy, else its value."""
    path = getattr(sketch, "_path", None)
    if not path or not os.path.exists(path):
        return np.frombuffer(sketch.value, dtype=np.uint8)
    if path not in MAPPED:
        with open(path, "rb") as f:
            head = f.read(64)
        # A pickled bytearray: its opcode, eight bytes of length, the bytes, and at most two opcodes.
        at = head.find(b"\x96") + 9
        size = int.from_bytes(head[at - 8 : at], "little") if at > 8 else -1
        if not 0 <= os.path.getsize(path) - at - size <= 2:
            return np.frombuffer(sketch.value, dtype=np.uint8)
        for gone in [p for p in MAPPED if not os.path.exists(p)]:  # a file that is mapped keeps its disk
            del MAPPED[gone]
        while len(MAPPED) >= 4:
            MAPPED.pop(next(iter(MAPPED)))
        MAPPED[path] = np.memmap(path, dtype=np.uint8, mode="r", offset=at, shape=(size,))
    return MAPPED[path]


def may_repeat(sketch: Broadcast, keys: np.ndarray, cells: int) -> np.ndarray:
    """Which keys the sketch estimates at its least count or more."""
    table = bits_of(sketch)
    out = np.ones(len(keys), dtype=bool)
    for numbers in _cells(keys, cells):
        out &= (table[numbers >> 3] >> (numbers & 7).astype(np.uint8)) & 1 == 1
    return out


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(0).to_numpy().view(np.uint64)


def member_bits(keys: DataFrame, is_cut: bool = False) -> tuple[Broadcast, int]:
    """A Bloom filter of the keys (one long column, no nulls), and its cells; it never misses one, and its size is bounded like any sketch's."""
    held = keys if is_cut else cut(keys)
    cells = cells_for(held.count(), 8)
    return repeated(held, _longs, cells, least=1), cells


def longs_in(bits: Broadcast, cells: int, keys: np.ndarray) -> np.ndarray:
    """Which longs may be in a Bloom filter."""
    return may_repeat(bits, keys.view(np.uint64), cells)


def member_test(keys: DataFrame) -> Callable[[Column], Column]:
    """A test whether a long may be among the keys; it parts rows that need a shuffle join from those that pass straight through."""
    bits, cells = member_bits(keys)

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(longs_in(bits, cells, key.to_numpy()))

    return test
