"""Give executors this package when they can't import it from a path of their own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once."""
    sc = spark.sparkContext
    if getattr(sc, "_palaver_shipped", False):
        return
    root = Path(__file__).resolve().parent
    kept = tempfile.TemporaryDirectory(prefix="palaver-sources-")  # executors fetch it from the driver at any time
    atexit.register(kept.cleanup)
    path = os.path.join(kept.name, f"palaver_sources_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._palaver_shipped = True
