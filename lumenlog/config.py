"""Settings in layers: defaults, a TOML file, environment variables, and what the caller gives; later layers win, section by section."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints
from zoneinfo import ZoneInfo

PREFIX = "LUMENLOG_"


@dataclass(frozen=True)
class Generation:
    base_url: str = "http://127.0.0.1:8080/v1"
    model: str = ""
    timeout: float = 300.0
    retries: int = 3
    context: int | None = None


@dataclass(frozen=True)
class Embeddings:
    base_url: str = "http://127.0.0.1:8081/v1"
    model: str = ""
    timeout: float = 120.0
    batch_size: int = 64
    max_input_chars: int = 8000
    context: int = 8192


@dataclass(frozen=True)
class Clustering:
    method: str = "hdbscan"
    min_cluster_size: int = 2
    distance_threshold: float = 0.3


@dataclass(frozen=True)
class Stacks:
    rules_path: str | None = None
    thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Denials:
    window_pct: int = 25
    thresholds: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    data_dir: str = "lumenlog-data"
    timezones: dict[str, str] = field(default_factory=dict)
    adapters: dict[str, str] = field(default_factory=dict)
    generation: Generation = Generation()
    embeddings: Embeddings = Embeddings()
    clustering: Clustering = Clustering()
    mcm: Denials = Denials()
    eustack: Stacks = Stacks()

    def __post_init__(self):
        for glob, zone in self.timezones.items():
            try:
                ZoneInfo(zone)
            except (KeyError, ValueError) as e:
                raise ValueError(f"invalid timezone {zone!r} for glob {glob!r}") from e
        if self.clustering.method not in ("hdbscan", "agglomerative"):
            raise ValueError(f"no clustering method: {self.clustering.method}")


def _merged(low: dict, high: dict) -> dict:
    out = dict(low)
    for key, value in high.items():
        if value is not None:
            out[key] = _merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _number(text: Any, kind: Any) -> Any:
    if not isinstance(text, str) or "str" in str(kind):
        return text
    return float(text) if kind is float else int(text)


def _pairs(thresholds: dict) -> dict[str, tuple[float, float]]:
    """{name: {warn, critical}} or {name: [warn, critical]}."""
    out = {}
    for name, value in thresholds.items():
        pair = (value["warn"], value["critical"]) if isinstance(value, dict) else tuple(value)
        out[name] = (float(pair[0]), float(pair[1]))
    return out


def _build(kind: type, values: dict) -> Any:
    hints = get_type_hints(kind)
    unknown = set(values) - set(hints)
    if unknown:
        raise ValueError(f"unknown settings of {kind.__name__.lower()}: {', '.join(sorted(unknown))}")
    given = {}
    for name, value in values.items():
        if dataclasses.is_dataclass(hints[name]):
            given[name] = _build(hints[name], value)
        else:
            given[name] = _pairs(value) if name == "thresholds" else _number(value, hints[name])
    return kind(**given)


def from_environment(environment: dict[str, str]) -> dict:
    """LUMENLOG_DATA_DIR, and LUMENLOG_<SECTION>_<NAME> of each section's plain settings."""
    out: dict = {}
    if f"{PREFIX}DATA_DIR" in environment:
        out["data_dir"] = environment[f"{PREFIX}DATA_DIR"]
    for section, kind in get_type_hints(Config).items():
        if dataclasses.is_dataclass(kind):
            for name in get_type_hints(kind):
                value = environment.get(f"{PREFIX}{section}_{name}".upper())
                if value is not None and name != "thresholds":
                    out.setdefault(section, {})[name] = value
    return out


def load(path: str | None = None, overrides: dict | None = None, environment: dict[str, str] | None = None) -> Config:
    layers: dict = {}
    if path and Path(path).exists():
        try:
            layers = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"invalid config file {path}: {e}") from e
    layers = _merged(layers, from_environment(dict(os.environ) if environment is None else environment))
    return _build(Config, _merged(layers, overrides or {}))
