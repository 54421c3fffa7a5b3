"""Folders for what a job keeps while it runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where it is unset: in a temporary folder in local mode,
    which is removed in the end, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        if not hasattr(folder, "own"):
            folder.own = tempfile.mkdtemp(prefix="rivulet-")
            atexit.register(shutil.rmtree, folder.own, ignore_errors=True)
        base = folder.own
    return f"{base or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"
