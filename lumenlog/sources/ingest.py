"""Artefact folders as event DataFrames: a task streams whole files, and a file that fails does not stop the others."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT
from .parsers import PARSERS, File, decompressed, detect

_COLUMNS = [c.split(" ")[0] for c in EVENT.split(", ")]
_STATS = ["adapter", "total_bytes", "unknown_bytes", "event_count", "notes", "error"]
_ROW = EVENT + ", adapter string, total_bytes long, unknown_bytes long, event_count long, notes array<string>, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "map<string,string>": pa.map_(pa.string(), pa.string()), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in _ROW.split(", "))])
#: Events that leave a task at once.
BATCH = 5000
#: Fixed value: the note of a link.
SKIPPED_LINK = "symbolic link, not followed"


def parse_overrides(specs: list[str]) -> dict[str, str]:
    """glob=parser specs, split at the last =."""
    out = {}
    for spec in specs:
        glob, found, name = spec.rpartition("=")
        if not found or not glob or name not in PARSERS:
            raise ValueError(f"not glob=parser: {spec}")
        out[glob] = name
    return out


def list_files(folder: str) -> tuple[list[str], list[str]]:
    """Regular files below the folder in sorted order, hidden ones too, and the symbolic links, which are not followed."""
    files, links = [], []
    for top, names, found in os.walk(folder):
        links += [os.path.join(top, n) for n in names if os.path.islink(os.path.join(top, n))]
        for n in found:
            path = os.path.join(top, n)
            if os.path.islink(path):
                links.append(path)
            elif os.path.isfile(path):
                files.append(path)
    return sorted(files), sorted(links)


def _first(globs: dict[str, str], path: str) -> str | None:
    return next((v for g, v in globs.items() if fnmatch.fnmatchcase(path, g)), None)


def _parsed(case_id: str, path: str, name: str, parser: str | None, zone: str | None) -> Iterator[dict]:
    """The file's events, then one row of statistics; a file that fails gives no events."""
    stats = dict.fromkeys(_COLUMNS) | {"case_id": case_id, "source_file": name, "total_bytes": 0, "unknown_bytes": 0, "event_count": 0, "notes": [], "error": None, "adapter": None}
    try:
        with open(path, "rb") as raw:
            file = File(case_id, name, decompressed(raw), datetime.fromtimestamp(os.stat(path).st_mtime, timezone.utc), zone)
            stats["adapter"] = detect(file, parser)
            yield from PARSERS[stats["adapter"]](file)
        stats |= {"total_bytes": file.total_bytes, "unknown_bytes": file.unknown_bytes, "event_count": file.events, "notes": file.notes}
    except Exception as e:  # recorded in the file's statistics row
        stats["error"] = f"{type(e).__name__}: {e}"
    yield stats


def parse_files(listed: DataFrame, case_id: str, overrides: dict[str, str], zones: dict[str, str]) -> DataFrame:
    """Event rows and a statistics row (without event_id) for each file of listed (path, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist(), strict=True):
                held: list[dict] = []
                for row in _parsed(case_id, path, name, _first(overrides, name), _first(zones, name)):
                    held.append(row | {"attrs": list((row["attrs"] or {}).items())})
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    return listed.mapInArrow(run, _ROW)


def read_artifacts(spark: SparkSession, folder: str, case_id: str, overrides: dict[str, str] | None = None, zones: dict[str, str] | None = None, parsed_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and parse statistics of the files in a folder that all executors see.

    Files are listed on the driver and streamed in parallel, a file to a task at a time. parsed_at: a shared folder where the parsed rows are
    written as Parquet, so that they are parsed once for good; without it Spark keeps them and parses lost ones again. A file that cannot be read keeps
    none of its events and has its error in its statistics row; a link has a note there. Statistics: case_id, source_file, adapter,
    total_bytes, unknown_bytes, event_count, notes, error, coverage.
    """
    files, links = list_files(folder)
    name_of = lambda p: Path(p).relative_to(folder).as_posix()
    listed = spark.createDataFrame([(p, name_of(p)) for p in files], "path string, name string")
    if files:
        listed = listed.repartition(min(len(files), 10_000), "path")
    parsed = parse_files(listed, case_id, overrides or {}, zones or {})
    if parsed_at:
        parsed.write.mode("overwrite").parquet(parsed_at)
        parsed = spark.read.parquet(parsed_at)
    else:
        parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    stats = parsed.where("event_id is null").select("case_id", "source_file", *_STATS)
    failed = stats.where("error is not null").select("source_file")
    events = parsed.where("event_id is not null").select(*_COLUMNS).join(failed, "source_file", "left_anti").select(*_COLUMNS)
    if links:
        rows = [(case_id, name_of(p), None, 0, 0, 0, [SKIPPED_LINK], None) for p in links]
        stats = stats.unionByName(spark.createDataFrame(rows, stats.schema))
    return events, stats.withColumn("coverage", coverage("unknown_bytes", "total_bytes"))


def coverage(unknown: str, total: str):
    """1 - unknown / total; 1 for an empty file."""
    return F.coalesce(1 - F.try_divide(unknown, total), F.lit(1.0))
