"""L8. Sources to training examples, as stages that are written once and found again after a failure.

The table of a stage lies in ``<root>/<stage>-<key>`` and its manifest, written only when the table is complete, in
``<root>/manifest/<stage>-<key>``. The key follows from the recipe and from the stages before, so another recipe starts
anew beside the old tables, and a run that was stopped goes on at the first stage without a manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import corpus, decontaminate
from wardline.plans import training
from wardline.settings import LABEL_CLASSES
from wardline.sources.corpus import Source, load_sources

#: ``(name, previous table or None -> table)``; tables carry ``text, label``.
Stage = tuple[str, Callable[[DataFrame | None], DataFrame]]


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_stages(spark: SparkSession, root: str, stages: Sequence[Stage], recipe: str) -> tuple[DataFrame, DataFrame]:
    """``(table of the last stage, manifests)``; manifests are ``position, stage, key, n_rows, label, n, written_at``,
    one row per stage and class. A stage with a manifest is read, not run; a table without one is overwritten."""
    table, manifests, key = None, None, recipe
    for position, (name, run) in enumerate(stages):
        key = hashlib.md5(f"{key}\n{name}".encode()).hexdigest()
        path, proof = f"{root}/{name}-{key}", f"{root}/manifest/{name}-{key}"
        manifest = _written(spark, proof)
        if manifest is None:
            run(table).write.mode("overwrite").parquet(path)
            written = spark.read.parquet(path)
            counts = corpus.label_counts(written).crossJoin(F.broadcast(written.agg(F.count(F.lit(1)).alias("n_rows"))))
            counts.select(
                F.lit(position).alias("position"), F.lit(name).alias("stage"), F.lit(key).alias("key"), "n_rows", "label", "n",
                F.current_timestamp().alias("written_at"),
            ).coalesce(1).write.mode("overwrite").parquet(proof)
            manifest = spark.read.parquet(proof)
        table = spark.read.parquet(path)
        manifests = manifest if manifests is None else manifests.unionByName(manifest)
    return table, manifests


def corpus_stages(spark: SparkSession, sources: Sequence[Source], banned: DataFrame, goals: DataFrame) -> list[Stage]:
    """All examples in source order; one row a text, with its first label; without benchmark texts and rows that embed a goal."""

    def clean(examples: DataFrame) -> DataFrame:
        known = F.concat_ws("-", "src_order", "row_order", F.hex(F.xxhash64("text")))
        return decontaminate.decontaminate(examples.withColumn("_row", known), banned, goals, "_row").drop("_row")

    return [
        ("examples", lambda _: load_sources(spark, sources)),
        ("distinct", corpus.dedup_first),
        ("clean", clean),
    ]


def build(
    spark: SparkSession, root: str, sources: Sequence[Source], banned: DataFrame, goals: DataFrame, revision: str = "",
) -> tuple[DataFrame, DataFrame]:
    """``(src_order, row_order, text, label of the clean examples; manifests)``, see ``run_stages``.

    The recipe is the order and names of the sources and ``revision``; give another one when the landed data, the mappers or the
    benchmarks change. Null and blank texts are dropped; no source rows give an empty table with a manifest of zeros.
    """
    recipe = "\n".join([revision, *(f"{s.name}\t{s.row_order or ''}" for s in sources)])
    return run_stages(spark, root, corpus_stages(spark, sources, banned, goals), recipe)


def build_and_ship(
    spark: SparkSession, root: str, sources: Sequence[Source], banned: DataFrame, goals: DataFrame, models: str,
    revision: str = "", **options,
) -> dict:
    """L8 as one job: build the corpus, train on it, pass both gates, ship. ``options`` go to ``training.train_and_ship``; the
    outcome also holds ``stages``: rows that each stage kept."""
    examples, manifests = build(spark, root, sources, banned, goals, revision)
    kept = {r["stage"]: r["n_rows"] for r in manifests.where(F.col("label") == LABEL_CLASSES[0]).collect()}
    return {**training.train_and_ship(examples.select("text", "label"), models, source="corpus", **options), "stages": kept}
