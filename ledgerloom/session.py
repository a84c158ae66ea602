"""What a session needs before it runs this package's Python functions on executors."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, unless their Python finds it anyway."""
    home = Path(__file__).resolve().parent.parent
    found = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app not in _shipped and home not in found and home != Path(sys.prefix):
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/ledgerloom", "zip", home, "ledgerloom"))
    _shipped.add(app)
    return spark
