"""Streams in the shared folder, from inside tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from wardline.llm.common import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below ``spark.checkpoint.dir``, which the driver and all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(address: str):
    """``(file system, path)``: any store that Arrow knows by its scheme (file, hdfs, s3, gs ..)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address else (
        fs.LocalFileSystem(), address.removeprefix("file:"))
