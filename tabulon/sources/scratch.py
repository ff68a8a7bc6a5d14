"""A shared folder for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import IOHandlingError

_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder of this machine stands in if all runs in this process, and nothing else.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise IOHandlingError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tabulon-"))
        base = _OWN[0]
    return f"{base}/tabulon-{name}-{uuid.uuid4().hex}"
