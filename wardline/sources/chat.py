"""S10, S12, S13. Chat requests in; alerts and metric tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.requests import REQUEST_SCHEMA


def read_requests(spark: SparkSession, path: str, fmt: str = "json", extra: str = "") -> DataFrame:
    """S10. One row per chat request; ``extra`` adds DDL columns such as ``ts TIMESTAMP``."""
    schema = REQUEST_SCHEMA + (", " + extra if extra else "")
    return spark.read.schema(schema).format(fmt).load(path)


def stream_requests(
    spark: SparkSession, path: str, fmt: str = "json", extra: str = "", max_files: int = 1000
) -> DataFrame:
    """S10. Requests as they land; ``max_files`` bounds a micro-batch."""
    schema = REQUEST_SCHEMA + (", " + extra if extra else "")
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def metrics_long(wide: DataFrame, version: str, section: str, slices: list[str]) -> DataFrame:
    """S12. A wide metrics table as ``version, section, slice, metric, value``."""
    values = [c for c, t in wide.dtypes if c not in slices and t in ("double", "float", "int", "bigint")]
    slice_ = F.concat_ws("/", *[F.col(s).cast("string") for s in slices]) if slices else F.lit("all")
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return wide.select(
        F.lit(version).alias("version"), F.lit(section).alias("section"), slice_.alias("slice"), F.inline(pairs)
    )


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """S12. Append to a report table partitioned by version."""
    metrics.write.mode("append").partitionBy("version").format(fmt).save(path)


def append_alerts(alerts: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch of alerts as ``path/batch=<id>``: a batch that runs again replaces what its first attempt left."""
    alerts.select(F.col("alert").alias("value")).write.mode("overwrite").text(f"{path}/batch={batch_id}")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """``value, batch`` of all alerts written so far."""
    return spark.read.schema("value STRING, batch LONG").text(path)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """S13, X5. Alert lines of a stream, each exactly once: Spark replays an unfinished batch under the same id, and the batch's
    folder is overwritten, so a writer killed between its files and its commit leaves no copy.

    ``every`` (an interval such as ``10 seconds``) runs on; without it what has landed is written and the query ends.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        alerts.writeStream.foreachBatch(lambda rows, batch_id: append_alerts(rows, batch_id, path))
        .outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
