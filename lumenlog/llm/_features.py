"""Hashed features of texts, and small linear models on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._kernels import U, byte_blocks, mix, rolling, text_buffer, word_hashes

#: Byte classes for shapes: letters and other non-ASCII bytes a, capitals A, digits 0, white space one space, the rest as is.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_PAIR_DIMS = 2


def shape_features(column: pa.Array, dims: int) -> np.ndarray:
    """Dense rows: square roots of the shares of hashed 4-byte shapes, then of repeated words and of words seen before."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = np.zeros((n, dims), dtype=np.float32)
    begin, end = int(offsets[0]), int(offsets[-1])
    room = dims - _PAIR_DIMS
    if end - begin >= 4:
        shapes = _SHAPE[raw[begin:end]].astype(U)
        grams = shapes[:-3] | shapes[1:-2] << U(8) | shapes[2:-1] << U(16) | shapes[3:] << U(24)
        slot = (mix(grams, 31) % U(room)).astype(np.int64)
        place = np.arange(begin, end - 3)
        doc = np.searchsorted(offsets, place, side="right") - 1
        inside = place + 4 <= offsets[doc + 1]
        counts = np.bincount(doc[inside] * room + slot[inside], minlength=n * room).reshape(n, room)
        out[:, :room] = counts
        out[:, :room] /= np.maximum(counts.sum(axis=1, keepdims=True), 1)
        np.sqrt(out, out=out)
    (words,), starts = word_hashes(column, 1)
    for i in range(n):
        own = words[starts[i] : starts[i + 1]]
        if len(own) > 1:
            out[i, room] = np.sqrt(np.mean(own[1:] == own[:-1]))
            out[i, room + 1] = np.sqrt(1 - len(np.unique(own)) / len(own))
    return out


def presence(column: pa.Array, bits: int, gram: int = 6, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each hashed word and byte gram of the lower-case texts, once for each row; features below 2**bits.

    With slots (feature -> slot or -1), only features that have a slot, by slot.
    """
    column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    shift = U(64 - bits)
    keys = []

    def put(row: np.ndarray, hashes: np.ndarray, seed: int) -> None:
        feature = (mix(hashes, seed) >> shift).astype(np.int32)
        if slots is not None:
            feature = slots[feature]
            found = feature >= 0
            row, feature = row[found], feature[found]
        keys.append(row.astype(np.int64) << bits | feature)

    (words,), offsets = word_hashes(column, 1)
    put(np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets)), words, 61)
    for block, _ in byte_blocks(column, gram):
        grams = rolling(block.values[0], gram)
        sizes = block.end - block.start
        inside = np.ones(len(block.values[0]), dtype=bool)
        for back in range(1, gram):
            inside[np.maximum(block.end - back, block.start)] = False
        row = np.repeat(block.row.astype(np.int32), sizes)[: len(grams)]
        inside = inside[: len(grams)]
        put(row[inside], grams[inside], 62)
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient, x: np.ndarray, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam; deterministic."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression; the last is the constant, which isn't penalised."""

    def gradient(w: np.ndarray) -> np.ndarray:
        # Products in the type of x: a wider vector would make numpy copy all of x in each step.
        error = sigmoid((x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]) - y
        return np.append(x.T @ error.astype(x.dtype) + l2 * w[:-1], error.sum()) / len(y)

    return adam(gradient, np.zeros(x.shape[1] + 1))
