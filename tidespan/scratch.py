"""Folders for intermediate tables, where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, below a temporary folder on a local master only."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="tidespan-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidespan/{context.applicationId}/{name}-{uuid.uuid4().hex}"
