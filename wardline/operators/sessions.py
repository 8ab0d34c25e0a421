"""Idle expiry (W9): a gap longer than the TTL starts a fresh session.

Rows are first reduced to one per ``(key, bucket)`` with buckets one TTL wide. Two rows of one bucket
are never more than a TTL apart, so breaks fall between buckets only, and the ordered window that finds
them sees at most ``time span / TTL`` rows per key however many rows the key holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

MICROS = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970. A timestamp without a zone counts as UTC, whatever the session's zone."""
    if df.schema[ts].dataType != TimestampNTZType():
        return F.unix_micros(F.col(ts).cast("timestamp"))
    since = F.col(ts) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    day, hour, minute = (F.extract(F.lit(part), since).cast("long") for part in ("DAY", "HOUR", "MINUTE"))
    second = (F.extract(F.lit("SECOND"), since) * MICROS).cast("long")
    return ((day * 24 + hour) * 60 + minute) * (60 * MICROS) + second


def _bucket(at: Column, ttl_seconds: int) -> Column:
    if ttl_seconds < 0:
        raise ValueError("ttl_seconds cannot be negative")
    return F.floor(at / F.lit(max(ttl_seconds * MICROS, 1))) if ttl_seconds else at


def session_buckets(df: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int) -> DataFrame:
    """``keys, bucket, lo, hi, n, session``: one row per key and TTL-wide bucket, sessions numbered from 1."""
    at = micros(df, ts)
    spans = df.groupBy(*keys, _bucket(at, ttl_seconds).alias("bucket")).agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    idle = F.col("lo") - F.lag("hi").over(ordered)
    fresh = F.when(idle.isNull() | (idle > ttl_seconds * MICROS), 1).otherwise(0)
    return (
        spans.withColumn("_fresh", fresh)
        .withColumn("session", F.sum("_fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_fresh")
    )


def sessions(df: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int) -> DataFrame:
    """One row per session: ``keys, session, started, ended`` (microseconds) and row count ``n``."""
    return session_buckets(df, keys, ts, ttl_seconds).groupBy(*keys, "session").agg(
        F.min("lo").alias("started"), F.max("hi").alias("ended"), F.sum("n").alias("n")
    )


def with_session(df: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Every row with its session number. A hot ``(key, bucket)`` is split by adaptive skew join."""
    buckets = session_buckets(df, keys, ts, ttl_seconds).select(*keys, "bucket", "session")
    return (
        df.withColumn("bucket", _bucket(micros(df, ts), ttl_seconds))
        .join(buckets, [*keys, "bucket"])
        .drop("bucket")
    )
