"""Cutting long lineages with a reliable checkpoint in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
