"""Base-modification analytics on Spark."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it isn't installed there."""
    here = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='methloom-')}/methloom", "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
