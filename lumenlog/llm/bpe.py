"""Byte-pair encoding and decoding by a deterministic token automaton.

A byte-pair vocabulary defines, for each byte string, one canonical token sequence. The automaton that reads token
sequences and accepts only canonical ones is built by successive merge gadgets: it starts with one state and an arc for each
byte, and the gadget of merge (a, b) -> ab takes the arc b away from the states that a leads to and adds arcs ab. In the
result the state after a token depends on that token only, and a token v may follow u unless a gadget took the arc
away. `Automaton` keeps the gadgets as a table (token -> its two halves, in merge order) and works out an arc the first time
it is asked for: following the gadgets backwards from the pair shows whether one of them removed it. Arcs found are kept.

Encoding walks the bytes of a pre-split word left to right. Its state is the last token; it takes the longest next token that
an arc allows, and steps back where none leads on. Each prefix has one canonical path, so a place is entered once, and the
path that reaches the end is the encoding. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import KEPT, slices

#: Fixed value: how byte-level vocabularies split text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text kept with their tokens by each Python worker.
CACHE = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable in Latin-1, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(x for x in range(256) if x not in set(shown)):
        out[chr(256 + n)] = b
    return out


def read_vocabulary(path: str) -> dict:
    """What the automaton needs of a byte-level tokenizer file; read on the driver and sent to the workers.

    Its size is that of the vocabulary, whatever the input.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with options are not supported")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "added": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class _Kept:
    """A bounded dictionary: when the new half is full it becomes the old half, and the old half goes."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Automaton:
    """The token automaton of a vocabulary, and the tables to encode and decode with it."""

    def __init__(self, vocabulary: dict):
        alphabet = byte_alphabet()
        label = {t: bytes(alphabet[c] for c in t) for t in vocabulary["vocab"]}
        self.ids: list[int] = []  # vocabulary id of each token, in gadget order
        self.token: dict[bytes, int] = {}
        self.halves: list[tuple[int, int]] = []
        self.joined: dict[tuple[int, int], int] = {}
        for text in alphabet:
            if text in vocabulary["vocab"]:
                self._add(label[text], vocabulary["vocab"][text], None)
        for left, right in vocabulary["merges"]:
            self._gadget(label[left], label[right], vocabulary["vocab"][left + right])
        self.arcs: dict[int, bool] = {}
        size = max([*vocabulary["vocab"].values(), *vocabulary["added"].values()]) + 1
        self.labels = [b""] * size
        for text, i in vocabulary["vocab"].items():
            self.labels[i] = label[text]
        for text, i in vocabulary["added"].items():
            self.labels[i] = text.encode()
        self.added = {t: i.to_bytes(4, "little") for t, i in vocabulary["added"].items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(SPLIT)
        # The tokens' labels as a tree of bytes: (node, byte) -> node, and the token that ends at a node.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for text, v in self.token.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = v
        self.words, self.pieces = _Kept(CACHE // 4), _Kept(CACHE)

    def _add(self, label: bytes, i: int, halves: tuple[int, int] | None) -> int:
        n = len(self.ids)
        self.ids.append(i)
        self.token.setdefault(label, n)
        self.halves.append(halves or (n, n))
        return n

    def _gadget(self, left: bytes, right: bytes, i: int) -> None:
        """Merge left and right: the arc right goes from the states that left leads to; an arc for both comes."""
        pair = self.token[left], self.token[right]
        if pair in self.joined:
            return
        known = self.token.get(left + right)
        # A token that two merges give keeps its first gadget: only that one can be reached.
        self.joined[pair] = self._add(left + right, i, pair) if known is None else known

    def allows(self, u: int, v: int) -> bool:
        """Whether token v may follow token u: no gadget on the touching edges of the two removed the arc."""
        key = u << 32 | v
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self._follow(u, v)
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
        return found

    def _follow(self, u: int, v: int) -> bool:
        # Gadgets ran in order, so of the two touching tokens the younger one is taken apart first; a gadget that joins
        # the edges then counts only if it came before the one taken apart.
        limit = len(self.ids)
        while True:
            gadget = self.joined.get((u, v))
            if gadget is not None and gadget < limit:
                return False
            right, left = self.halves[u][1], self.halves[v][0]
            if right == u and left == v:
                return True
            if left == v or (u > v and right != u):
                limit, u = u, right
            else:
                limit, v = v + 1, left

    def word(self, raw: bytes) -> bytes:
        """Ids of a pre-split word, as little-endian 32-bit numbers.

        A place that an allowed path reached but could not leave is on no canonical path and isn't entered again, so the
        walk looks at each place once.
        """
        step, ends, arcs, n = self.step, self.ends, self.arcs, len(raw)
        path: list[int] = []
        choices: list[tuple[int, list]] = []
        dead: set[int] = set()
        at, u, options = 0, -1, None
        while at < n:
            if options is None:  # the tokens that start here, shortest first
                options, node, to = [], 0, at
                while to < n:
                    node = step.get(node << 8 | raw[to], 0)
                    if not node:
                        break
                    to += 1
                    v = ends[node]
                    if v >= 0:
                        options.append((to, v))
            while options:
                to, v = options.pop()
                if to not in dead:
                    if u < 0:
                        break
                    ok = arcs.get(u << 32 | v)
                    if self.allows(u, v) if ok is None else ok:
                        break
            else:
                dead.add(at)
                path.pop()
                at, options = choices.pop()
                u = path[-1] if path else -1
                continue
            path.append(v)
            choices.append((at, options))
            at, u, options = to, v, None
        return array("I", map(self.ids.__getitem__, path)).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece of text that begins where a word does."""
        out = []
        for word in self.split.findall(text):
            ids = self.words.get(word)
            if ids is None:
                ids = self.word(word.encode())
                if len(word) <= 64:
                    self.words.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        # A space before a character that is no space always begins a word, so pieces cut there are independent.
        first, *rest = _CUT.split(text) if _SPACES.search(text) else text.split(" ")
        out = list(map(self.pieces.new.get, rest))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    ids = self.pieces.get(rest[i])
                    if ids is None:
                        ids = self.piece(" " + rest[i])
                        if len(rest[i]) <= 64:
                            self.pieces.put(rest[i], ids)
                    out[i] = ids
        return self.piece(first) + b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; added tokens in the text are found first."""
        if self.special is None or not self.special.search(text):
            return self._plain(text) if text else b""
        out, at = [], 0
        for found in self.special.finditer(text):
            if found.start() > at:
                out.append(self._plain(text[at : found.start()]))
            out.append(self.added[found[0]])
            at = found.end()
        if at < len(text):
            out.append(self._plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The arc labels of the ids, one after the other; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


_CUT = re.compile(r" (?=\S)")
_SPACES = re.compile(r" (?:\s|$)")


def _automaton(broadcast) -> Automaton:
    """One automaton for each Python worker and vocabulary."""
    key = broadcast._jbroadcast.id() if getattr(broadcast, "_jbroadcast", None) is not None else id(broadcast)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Automaton(broadcast.value)
    return KEPT[key]


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Token ids and decoded text of each document, by the byte-level vocabulary in the file path (read on the driver).

    Returns id_col, n_tokens, ids (binary: little-endian unsigned 32-bit), ids_sha256, decoded (string) and decoded_sha256;
    without ids and decoded if with_ids is false. One row for each input row; other columns are left out. Null and empty texts
    have no tokens. Texts of any length are encoded whole. An empty table gives an empty table.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch in slices(batches, "text", keeps=True):
            ids = [automaton.encode(t or "") for t in batch.column("text").to_pylist()]
            decoded = [automaton.decode(x) for x in ids]
            columns = [
                batch.column("id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array([x.decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    extra = ", ids binary, decoded string" if with_ids else ""
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
