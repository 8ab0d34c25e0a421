"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.plans.lineage import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut", "hex_number", "need", "release", "shuffle_partitions", "small_batches"]


def need(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise early, by name, when a column that an operator reads is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Whatever runs inside sends Python at most ``rows`` wide rows at once; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let the driver notice that earlier rounds of an iteration are unreachable, so that Spark deletes their shuffle
    files and checkpoints now and not at the next periodic collection (``spark.cleaner.periodicGC.interval``)."""
    spark.sparkContext._jvm.System.gc()


def hex_number(text: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of the text's MD5 as a whole number; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
