"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that the operators rely on.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def session(name: str = "lumenlog", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_lumenlog_shipped", False):
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="lumenlog-")) / "lumenlog.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(str(path))
    context._lumenlog_shipped = True
