"""Reading tables for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when a scan has fewer splits than there are cores.

    A text pipeline costs far more per row than moving the row, so a table of few row groups is
    redistributed by its row key. A scan with enough splits, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
