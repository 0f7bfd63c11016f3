"""Connection to a local model server, and stand-ins that need none.

Vectors are made where the rows are, batch by batch; the stand-in hashes words, so that equal texts get equal vectors anywhere.
"""

from __future__ import annotations

import ipaddress
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .config import Embeddings, Generation

#: Characters that a token stands for in budgets, seconds before the first retry, characters of an answer at most, a seed that means any.
CHARS_A_TOKEN, FIRST_WAIT, ANSWER = 2, 0.5, 200_000
ANY_SEED = 0xFFFFFFFF


def require_local(base_url: str, allow_public: bool = False) -> None:
    """Refuse endpoints that are neither localhost nor a loopback or private address; names are not resolved."""
    host = urlsplit(base_url).hostname or ""
    if host == "localhost" or host.endswith(".localhost") or allow_public:
        return
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        address = None
    if address is None or not (address.is_loopback or address.is_private):
        raise ValueError(f"not a local endpoint: {base_url!r}")


def packed(texts: Sequence[str], characters: int, most: int) -> list[list[str]]:
    """texts in order, in batches of at most `most` texts and `characters` in all; a longer text goes alone."""
    out: list[list[str]] = []
    size = 0
    for text in texts:
        if not out or len(out[-1]) >= most or size + len(text) > characters:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def vector_of(value: object) -> list[float]:
    """A non-empty list of finite numbers."""
    if not isinstance(value, list) or not value or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in value):
        raise ValueError("not a non-empty list of finite numbers")
    return [float(x) for x in value]


def by_index(rows: object, count: int) -> list[list[float]]:
    """The vectors of a reply in request order: each index once."""
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows) or sorted(str(r.get("index")) for r in rows) != sorted(map(str, range(count))):
        raise ValueError("the reply does not have each index once")
    return [vector_of(r.get("embedding")) for r in sorted(rows, key=lambda r: r["index"])]


class Server:
    """A server with the usual /embeddings and /chat/completions paths."""

    def __init__(self, generation: Generation, embeddings: Embeddings, allow_public: bool = False):
        for url in (generation.base_url, embeddings.base_url):
            require_local(url, allow_public)
        self.generation, self.embeddings = generation, embeddings

    def _ask(self, url: str, body: dict | None, timeout: float) -> dict:
        """The reply's object; refused connections, time-outs and server errors are tried again, waiting twice as long each time."""
        for turn in range(self.generation.retries + 1):
            try:
                request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    found = json.loads(reply.read())
                if not isinstance(found, dict):
                    raise ValueError("the reply is no object")
                return found
            except urllib.error.HTTPError as e:
                if e.code < 500 or turn == self.generation.retries:
                    raise ValueError(f"{url} refused: {e.code} {e.read()[:500].decode(errors='replace')}") from e
            except OSError:
                if turn == self.generation.retries:
                    raise
            time.sleep(FIRST_WAIT * 2**turn)
        raise AssertionError

    def chat(self, messages: list[dict[str, str]], schema: dict | None = None) -> str:
        body = {"model": self.generation.model, "messages": messages, "temperature": 0} | ({"response_format": {"type": "json_schema", "schema": schema}} if schema else {})
        found = self._ask(f"{self.generation.base_url.rstrip('/')}/chat/completions", body, self.generation.timeout)
        try:
            content = found["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ValueError("the reply has no content") from e
        if not isinstance(content, str) or not content.strip():
            raise ValueError("the reply is empty")
        return content[:ANSWER]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """Vectors in the order of texts, all of one length; each text is cut to the longest input."""
        s, out = self.embeddings, []
        for batch in packed([t[: s.max_input_chars] for t in texts], s.context * CHARS_A_TOKEN, s.batch_size):
            out += by_index(self._ask(f"{s.base_url.rstrip('/')}/embeddings", {"model": s.model, "input": batch}, s.timeout).get("data"), len(batch))
        if len({len(v) for v in out}) > 1:
            raise ValueError("vectors of different lengths")
        return out

    def _root(self) -> str:
        parts = urlsplit(self.generation.base_url)
        return f"{parts.scheme}://{parts.netloc}"

    def properties(self) -> dict:
        """What the server says of itself; empty if it does not."""
        try:
            return self._ask(f"{self._root()}/props", None, 10.0)
        except (OSError, ValueError):
            return {}

    def models(self) -> list[str]:
        rows = self._ask(f"{self.generation.base_url.rstrip('/')}/models", None, 10.0).get("data")
        return sorted(str(r["id"]) for r in rows if isinstance(r, dict) and "id" in r) if isinstance(rows, list) else []

    def count_tokens(self, text: str) -> int | None:
        """The server's count, None where it has none."""
        try:
            found = self._ask(f"{self._root()}/tokenize", {"content": text}, 10.0).get("tokens")
        except (OSError, ValueError):
            return None
        return len(found) if isinstance(found, list) else None


def determinism_warnings(properties: dict) -> list[str]:
    """What in a server's settings lets equal prompts give different answers."""

    def number(value: object) -> float | None:
        return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None

    settings = properties.get("default_generation_settings")
    settings = settings if isinstance(settings, dict) else {}
    source = settings["params"] if isinstance(settings.get("params"), dict) else settings
    slots, seed, temperature = number(properties.get("n_parallel")), number(source.get("seed")), number(source.get("temperature"))
    out = []
    if slots is not None and slots > 1:
        out.append(f"n_parallel={slots}: use one slot")
    if seed is not None and (seed < 0 or seed == ANY_SEED):
        out.append(f"seed is random ({seed}): set one")
    if temperature is not None and temperature > 0:
        out.append(f"temperature is {temperature}: set 0")
    return out


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    """Signed counts of hashed words, of length 1; the stand-in for a model's vector."""
    out = np.zeros(dims)
    for word in text.lower().split() or [""]:
        h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dims] += 1 if h >> 63 else -1
    return (out / (np.linalg.norm(out) or 1.0)).tolist()


def embedder(embed: Callable[[Sequence[str]], list[list[float]]] | None = None, text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A function that adds embedding to a frame with text, an Arrow batch at a time, by embed (sent to the executors) or the stand-in."""
    make = embed or (lambda texts: [hashed_vector(t) for t in texts])

    def run(rows: DataFrame) -> DataFrame:
        def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(embedding=make([t or "" for t in frame[text_col]]) if len(frame) else [])

        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        return rows.mapInPandas(batch, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))

    return run
