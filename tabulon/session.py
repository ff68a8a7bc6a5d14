"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put the folder that holds this package on the Python workers' path, whatever folder the driver runs in."""
    environment = spark.sparkContext.environment
    have = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark
