"""This package on the executors of a cluster, whose Python workers may not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_strataq_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="strataq-code-"))
    atexit.register(shutil.rmtree, str(folder), ignore_errors=True)
    with zipfile.ZipFile(folder / "strataq.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"strataq/{f.relative_to(root)}")
    sc.addPyFile(str(folder / "strataq.zip"))
    sc._strataq_shipped = True
