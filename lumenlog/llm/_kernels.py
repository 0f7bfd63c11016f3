"""Vectorised hashing of byte and word sequences.

Everything works on flat uint64 arrays that hold many documents one after the other, so a Python worker pays
per block of text and not per document or word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_MAX = U(0xFFFFFFFFFFFFFFFF)
_NONE = np.uint32(0xFFFFFFFF)
#: Two multipliers for polynomial hashes modulo 2**64; 3 modulo 8, so that powers differ early.
BASES = (U(0x9E3779B97F4A7C1B), U(0xD1342543DE82EF9B))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Units handled at once, so that their arrays stay in the processor's cache; longer documents are cut into overlapping blocks.
BLOCK = 1 << 16


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> U(30)
        z *= U(0xBF58476D1CE4E5B9)
        z ^= z >> U(27)
        z *= U(0x94D049BB133111EB)
        z ^= z >> U(31)
        return z


_BYTES = tuple(mix(np.arange(256, dtype=U), 100 + lane) for lane in (0, 1))


def _power(base: U, exponent: int) -> U:
    return U(pow(int(base), exponent, 1 << 64))


def rolling(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Polynomial hash of every run of width values, by doubling; shorter than values by width - 1."""
    base, n = BASES[lane], len(values)
    if n < width:
        return np.empty(0, dtype=U)
    done, done_width, step, step_width, rest = None, 0, values, 1, width
    while True:
        if rest & 1:
            if done is None:
                done, done_width = step, step_width
            else:
                size = n - done_width - step_width + 1
                done = done[:size] * _power(base, step_width)
                done += step[done_width : done_width + size]
                done_width += step_width
        rest >>= 1
        if not rest:
            return done
        size = n - 2 * step_width + 1
        twice = step[:size] * _power(base, step_width)
        twice += step[step_width : step_width + size]
        step = twice
        step_width *= 2


def _sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every run of width values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = op(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        out = op(out[: len(out) - (width - reach)], out[width - reach :])
    return out


@dataclass
class Block:
    """Units (bytes or words) of one or more documents.

    values: a uint64 array for each lane. row, first, start, end: for each piece its row in the batch, the document's unit
    at which it starts, and its place in values. low, high: the units of values that this piece answers for (the rest overlaps).
    """

    values: tuple[np.ndarray, ...]
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def piece_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw, offsets


def _blocks(lengths: np.ndarray, halo: int, limit: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """(row, from, to, low, high) in units of each document, in groups of about limit units."""
    group, total = [], 0
    for row, n in enumerate(lengths.tolist()):
        if not n:
            continue
        for low in range(0, n, limit):
            high = min(n, low + limit)
            piece = (row, max(0, low - halo), min(n, high + halo), low, high)
            if group and total + piece[2] - piece[1] > limit:
                yield group
                group, total = [], 0
            group.append(piece)
            total += piece[2] - piece[1]
    if group:
        yield group


def _gather(group: list, offsets: np.ndarray, sources: tuple[np.ndarray, ...]) -> Block:
    row, begin, stop, low, high = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
    sizes = stop - begin
    end = np.cumsum(sizes)
    start = end - sizes
    values = tuple(np.concatenate([s[offsets[r] + b : offsets[r] + e] for r, b, e, _, _ in group]) for s in sources)
    return Block(values, row, begin, start, end, start + low - begin, start + high - begin)


def byte_blocks(column: pa.Array, halo: int, lanes: int = 1) -> Iterator[tuple[Block, np.ndarray]]:
    """Blocks of the texts' bytes, and the bytes themselves."""
    raw, offsets = text_buffer(column)
    for group in _blocks(np.diff(offsets), halo, BLOCK):
        block = _gather(group, offsets, (raw,))
        data = block.values[0]
        block.values = tuple(_BYTES[lane][data] for lane in range(lanes))
        yield block, data


@functools.lru_cache(maxsize=4)
def _powers(lane: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first size powers of a lane's base, and of its inverse."""
    base = BASES[lane]
    powers = np.full(size, base, dtype=U)
    back = np.full(size, U(pow(int(base), -1, 1 << 64)), dtype=U)
    powers[:1] = back[:1] = 1
    return np.multiply.accumulate(powers), np.multiply.accumulate(back)


def prefix_sums(values: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """What range_hashes needs of an array."""
    powers, back = _powers(lane, max(BLOCK, 1 << (len(values) - 1).bit_length()) if len(values) else BLOCK)
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums, back[: len(values)]


def range_hashes(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], which may differ in length."""
    sums, back = prefix
    return (sums[ends] - sums[starts]) * back[starts]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Hashes of data[start:end], in each lane: mixed eight bytes at a time with their place, so that no algebra of the bytes carries over."""
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    place, at, left = np.zeros(len(starts), dtype=U), starts, sizes
    several = counts.max(initial=0) > 1
    if several:
        first = np.cumsum(counts) - counts
        word = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(word)) - first[word]
        at, left, place = starts[word] + 8 * nth, sizes[word] - 8 * nth, nth.astype(U)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    chunks = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))[at]
    chunks &= _MAX >> (U(64) - U(8) * np.minimum(left, 8).astype(U))
    out = []
    for lane in range(lanes):
        mixed = mix(chunks ^ mix(place, 40 + lane), 42 + lane)
        if several:
            mixed = np.add.reduceat(mixed, first)
        out.append(mix(mixed + sizes.astype(U), 44 + lane))
    return out


def word_bounds(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; no run crosses a document's start."""
    space = _SPACE[data]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    before[:1] = True
    after[-1:] = True
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
    before[inner] = True
    after[inner - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def word_hashes(column: pa.Array, lanes: int = 2) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Hashes of all words of the texts, in each lane, and the offsets of the documents in them."""
    raw, offsets = text_buffer(column)
    parts: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    at, last = 0, len(offsets) - 1
    while at < last:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
        begin = int(offsets[at])
        while begin < offsets[stop] or begin == int(offsets[at]):
            end = int(offsets[stop])
            if end - begin > 2 * BLOCK:  # one long document: cut it at white space
                window = _SPACE[raw[begin + BLOCK : end]]
                cut = int(window.argmax()) if window.any() else len(window)
                end = begin + BLOCK + cut
            data = raw[begin:end]
            doc_starts = offsets[at:stop] - begin
            starts, ends = word_bounds(data, doc_starts)
            if stop == at + 1:
                counts[at] += len(starts)
            else:
                counts[at:stop] = np.diff(np.searchsorted(starts, np.append(doc_starts, len(data))))
            for part, hashes in zip(parts, _word_hashes(data, starts, ends, lanes), strict=True):
                part.append(hashes)
            begin = end
            if begin >= offsets[stop]:
                break
        at = stop
    total = np.concatenate([[0], np.cumsum(counts)])
    return tuple(np.concatenate(p) if p else np.empty(0, dtype=U) for p in parts), total


def word_blocks(hashes: tuple[np.ndarray, ...], offsets: np.ndarray, halo: int) -> Iterator[Block]:
    for group in _blocks(np.diff(offsets), halo, BLOCK):
        yield _gather(group, offsets, hashes)


def anchors(block: Block, gram: int, width: int, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Content-chosen positions: every window of width units holds one, chosen by the window's content alone.

    A position is an anchor if the hash of its gram units is the least of some window that lies within its document.
    Equal windows have their anchors at equal places, so a repeated window always shows as a repeated anchor gram.
    Returns positions in the block and the grams' hashes; with own, only positions that the block answers for.
    """
    values, n = block.values[0], len(block.values[0])
    if n < width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    span = width - gram + 1
    sums, back = prefix_sums(values, 0)
    grams = sums[gram:] - sums[:-gram]
    grams *= back[: len(grams)]
    # The upper half of a hash gives the order, at half the cost; between 1 and 2**31, so that neither mark is a gram's.
    order = np.full(n, _NONE, dtype=np.uint32)
    order[: len(grams)] = grams >> U(33)
    order[: len(grams)] += np.uint32(1)
    for end in block.end.tolist():  # grams and windows that would cross the end of their document
        order[max(0, end - gram + 1) : end] = _NONE
    least = _sliding(order, span, np.minimum)
    for end in block.end.tolist():
        least[max(0, end - width + 1) : end] = 0
    padded = np.zeros(n + span - 1, dtype=np.uint32)
    padded[span - 1 : span - 1 + len(least)] = least
    top = _sliding(padded, span, np.maximum)[:n]
    chosen = np.flatnonzero((top == order) & (order != _NONE))
    if own:
        piece = block.piece_of(chosen)
        chosen = chosen[(chosen >= block.low[piece]) & (chosen < block.high[piece])]
    return chosen, mix(grams[chosen], 7)
