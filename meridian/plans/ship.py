"""Sends this package to executors that cannot import it from a folder of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's application, once. Spark itself carries it to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="meridian-")) / "meridian_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _sent.add(sc.applicationId)
