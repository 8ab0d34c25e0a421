"""S11, J8, X6. Versioned models as tables under one root.

``terms/version=..`` holds the wide model table, ``versions`` one metadata row per trained version,
``pointer`` one row per activation; the latest activation names the current version.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.blocks import not_above
from wardline.operators.linear_scorer import LinearModel, load_linear
from wardline.operators.selection import newest_versions
from wardline.settings import HEADS

log = logging.getLogger("wardline.registry")
VERSION_FORMAT = "v%Y%m%d-%H%M%S"


@dataclass(frozen=True)
class Model:
    version: str
    terms: DataFrame
    intercepts: dict[str, float]
    metadata: dict


def new_version(now: datetime | None = None) -> str:
    """T19 on the driver."""
    return (now or datetime.now(timezone.utc)).strftime(VERSION_FORMAT)


def write_version(terms: DataFrame, root: str, version: str, intercepts: dict[str, float], metadata: dict) -> None:
    """S11. Write a version; it becomes readable by name but not current."""
    spark = terms.sparkSession
    terms.write.mode("errorifexists").parquet(f"{root}/terms/version={version}")
    row = [(version, json.dumps({**metadata, "version": version, "intercepts": intercepts}))]
    spark.createDataFrame(row, "version STRING, metadata STRING").write.mode("append").parquet(f"{root}/versions")


def activate(spark: SparkSession, root: str, version: str, at: datetime | None = None) -> None:
    """Repoint; an append, so readers never see a half-written pointer. Also rolls back to an older version."""
    spark.range(1).select(
        F.lit(version).alias("version"), (F.current_timestamp() if at is None else F.lit(at).cast("timestamp")).alias("activated_at")
    ).write.mode("append").parquet(f"{root}/pointer")


def activations(spark: SparkSession, root: str) -> DataFrame | None:
    """``version, activated_at`` of every activation; None when nothing was ever activated."""
    try:
        return spark.read.parquet(f"{root}/pointer")
    except AnalysisException:
        return None


def current_version(spark: SparkSession, root: str, at: datetime | None = None) -> str | None:
    """The version activated last, or last at a time: of equal times the greater name."""
    pointer = activations(spark, root)
    if pointer is None:
        return None
    if at is not None:
        pointer = pointer.where(F.col("activated_at") <= F.lit(at))
    return pointer.agg(F.max_by("version", F.struct("activated_at", "version"))).first()[0]


def version_as_of(rows: DataFrame, pointer: DataFrame, at: str = "ts", out: str = "model_version") -> DataFrame:
    """J8. Rows and the version that was current at each row's time; null before the first activation.

    An as-of join: activations become spans from one to the next, sorted in one array (one entry an activation; deployments
    are few next to requests), and each row finds its span by binary search in place. Rows are not shuffled. A null
    time has no version; columns of ``rows`` keep their names, ``out`` is replaced.
    """
    times = F.array_sort(F.collect_list(F.struct(F.col("activated_at").alias("at"), "version")))
    spans = pointer.where("activated_at is not null").groupBy().agg(times.alias("_spans"))
    joined = rows.drop(out).join(F.broadcast(spans), F.lit(True), "left")
    place = not_above(F.col("_spans.at"), F.col(at))
    found = F.when(F.col(at).isNotNull() & (place > 0), F.get(F.col("_spans.version"), place - 1))
    return joined.withColumn(out, found).drop("_spans")


def load_model(spark: SparkSession, root: str, version: str | None = None, at: datetime | None = None) -> Model | None:
    """J8. The current version, the one of a time, or a pinned one; None when none was active."""
    version = version or current_version(spark, root, at)
    if version is None:
        return None
    versions = spark.read.parquet(f"{root}/versions").where(F.col("version") == version)
    row = versions.select("metadata").first()
    if row is None:
        raise ValueError(f"unknown model version {version}")
    metadata = json.loads(row["metadata"])
    terms = spark.read.parquet(f"{root}/terms/version={version}")
    intercepts = {h: metadata["intercepts"][h] for h in metadata.get("heads", HEADS)}
    return Model(version, terms, intercepts, metadata)


def kept_versions(spark: SparkSession, root: str, keep: int) -> DataFrame:
    """K2. Versions retention keeps; cleaning the other partitions is left to storage policy."""
    return newest_versions(spark.read.parquet(f"{root}/versions"), keep)


class ModelRefresher:
    """X6. Model handle for ``foreachBatch``: one pointer read per micro-batch, a reload only on change,
    and the last good model while the new one cannot be read."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root
        self._loaded: Model | None = None
        self._linear: tuple[str, LinearModel] | None = None

    def get(self) -> Model | None:
        try:
            version = current_version(self._spark, self._root)
            if version is None:
                self._loaded = None
            elif self._loaded is None or self._loaded.version != version:
                self._loaded = load_model(self._spark, self._root, version)
        except Exception as error:  # a version still being written fails in many ways
            log.warning("keeping model %s: %s", self._loaded and self._loaded.version, error)
        return self._loaded

    def linear(self, model: Model) -> LinearModel:
        """Arrays of ``model``, built once per version."""
        if self._linear is None or self._linear[0] != model.version:
            self._linear = (model.version, load_linear(model.terms, model.intercepts))
        return self._linear[1]
