"""Cutting lineage where a result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder from ``spark.checkpoint.dir``; a temporary one is made for local masters only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            current = tempfile.mkdtemp(prefix="wardline-checkpoint-")
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and later reads start from files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
