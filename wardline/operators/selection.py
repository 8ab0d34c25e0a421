"""Ordered picks: newest versions (K2, K5), recent keys (K3), last turns (K4), fixed-size sample (K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_versions(versions: DataFrame, keep: int, column: str = "version") -> DataFrame:
    """K2, K5. The ``keep`` greatest version names; a bounded top-k, not a global sort."""
    return versions.select(column).distinct().orderBy(F.desc(column)).limit(keep)


def recent_keys(df: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """K3. The ``limit`` most recently seen keys."""
    return df.groupBy(key).agg(F.max(ts).alias("last_seen")).orderBy(F.desc("last_seen"), key).limit(limit)


def last_turns(turns: DataFrame, keys: Sequence[str], order: str, keep: int = 50) -> DataFrame:
    """K4. The last ``keep`` rows per key. Spark limits each key per map task before the shuffle, so a
    hot key sends ``keep`` rows per task, not all of them."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return turns.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= keep).drop("_rank")


def sample_n(df: DataFrame, text: str, n: int) -> DataFrame:
    """K6. ``n`` rows picked by content hash: the same ones on every run."""
    return df.orderBy(F.md5(F.col(text)), F.col(text)).limit(n)
