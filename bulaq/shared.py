"""The folder that all executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own where a local session names none, an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if not at:
            at = shared_dir.own = Path(tempfile.mkdtemp(prefix="bulaq-")).as_uri()
    return at.rstrip("/")
