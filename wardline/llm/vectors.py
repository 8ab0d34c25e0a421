"""Reading vectors: validity, unit length, classes of equal vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut


def pick_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``id long, dim int, raw binary, unit binary`` (little-endian doubles). ``raw`` and ``unit`` are null for a vector that is
    null, empty, zero, or holds a null or non-finite component."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, units, dims = [], [], []
            for value in batch.column(1).to_pylist():
                x = None if value is None or None in value else np.array(value, "<f8")
                scale = 0.0 if x is None or not len(x) else float(np.abs(x).max())
                if scale == 0.0 or not np.isfinite(scale):
                    raws.append(None), units.append(None), dims.append(0)
                    continue
                u = x / scale
                raws.append((x + 0.0).tobytes()), units.append((u / np.sqrt(u @ u)).tobytes()), dims.append(len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(units, pa.binary())],
                ["id", "dim", "raw", "unit"])

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(
        read, "id long, dim int, raw binary, unit binary")


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors: ``rid`` (smallest id), ``weight`` (rows), ``dim, raw, unit``; and members ``id, digest``.

    Copies collapse before the shuffle; a class is known by its vector's 128-bit ``digest``.
    """
    valid = rows.where("unit is not null and id is not null").withColumn("digest", F.md5("raw"))
    classes = cut(valid.groupBy("digest").agg(
        F.min("id").alias("rid"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("raw").alias("raw"),
        F.first("unit").alias("unit")))
    return classes, valid.select("id", "digest")
