"""S1. Labelled CSV directory with ``text`` and ``label`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.settings import LABEL_CLASSES


#: Longest list of files that travels to the rows; a longer one is joined.
MAX_TRAVEL_FILES = 100_000


def _file_order(spark: SparkSession, path: str) -> DataFrame:
    """``_file, src_order``: every file in name order, from 1. Files are listed, none is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return listed.select(F.col("_metadata.file_path").alias("_file")).withColumn(
        "src_order", F.row_number().over(Window.orderBy("_file"))
    )


def labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """``src_order, row_order, text, label`` of every ``*.csv`` under ``path``, files in name order (files without rows
    count), rows of a file in its order.

    Raises when there is no file, a column is missing, headers disagree, or a label is unknown (the first
    such row ends the check).
    """
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("enforceSchema", False).option("pathGlobFilter", "*.csv").csv(path)
    )
    missing = {"text", "label"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} must have `text` and `label` columns.")
    rows = raw.select(
        "text", "label", F.col("_metadata.file_path").alias("_file"),
        F.monotonically_increasing_id().alias("row_order"),
    )
    unknown = rows.where(~F.col("label").isin(*LABEL_CLASSES) | F.col("label").isNull()).limit(1).collect()
    if unknown:
        raise ValueError(f"{path}: unknown label '{unknown[0]['label']}', expected one of {list(LABEL_CLASSES)}")
    names = _file_order(spark, path)
    # A text never moves for its file's place as long as the list of files is short.
    known = F.broadcast(names) if names.count() <= MAX_TRAVEL_FILES else names
    return rows.where(F.col("text").isNotNull()).join(known, "_file").select("src_order", "row_order", "text", "label")
