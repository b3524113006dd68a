"""Sends this package to the executors, which needn't have it installed."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Once for each application, as --py-files would; Spark's file server hands the archive out."""
    sc = (spark or SparkSession.active()).sparkContext
    if sc.applicationId not in _sent:
        _sent.add(sc.applicationId)
        package = Path(__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name))
