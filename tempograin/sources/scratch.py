"""A folder for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a folder of our own only on a single machine where that is unset."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    shared = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
