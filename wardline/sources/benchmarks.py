"""S3-S7. Benchmark sets in their public layouts, as ``bench, text, is_attack, category``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bench(source: DataFrame, name: str, text: Column, attack: Column, category: Column, keep: Sequence[str]) -> DataFrame:
    """``keep`` names further columns to carry along, such as verdicts found before."""
    return source.select(
        F.lit(name).alias("bench"), text.alias("text"), attack.cast("boolean").alias("is_attack"),
        category.alias("category"), *keep,
    )


def pint(source: DataFrame, name: str = "pint", keep: Sequence[str] = ()) -> DataFrame:
    """S3. ``text, label, category``."""
    return _bench(source, name, F.col("text").cast("string"), F.col("label"), F.col("category"), keep)


def jbb(harmful: DataFrame, benign: DataFrame, name: str = "jbb", keep: Sequence[str] = ()) -> DataFrame:
    """S4. Two splits of ``Goal, Category``."""

    def side(source: DataFrame, split: str, attack: bool) -> DataFrame:
        return _bench(source, name, F.col("Goal"), F.lit(attack), F.concat_ws("/", F.lit(split), F.col("Category")), keep)

    return side(harmful, "harmful", True).unionByName(side(benign, "benign", False))


def safeguard(source: DataFrame, name: str = "safeguard", keep: Sequence[str] = ()) -> DataFrame:
    """S5. ``text, label``."""
    attack = F.col("label") == 1
    return _bench(
        source, name, F.col("text"), attack, F.when(attack, F.lit("prompt_injection")).otherwise(F.lit("benign")), keep,
    )


def gandalf(source: DataFrame, name: str = "gandalf", keep: Sequence[str] = ()) -> DataFrame:
    """S6. ``text``; every row is an attack."""
    return _bench(source, name, F.col("text"), F.lit(True), F.lit("prompt_injection"), keep)


def xstest(source: DataFrame, name: str = "xstest", keep: Sequence[str] = ()) -> DataFrame:
    """S7. ``prompt, label, type``."""
    return _bench(
        source, name, F.col("prompt"), F.col("label") == "unsafe", F.concat_ws("/", F.col("label"), F.col("type")), keep,
    )


def union_benchmarks(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets)
