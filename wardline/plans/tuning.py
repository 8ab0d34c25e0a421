"""A26, T11, L3. Thresholds tuned on the validation part, kept as biases with the version, measured on the test part."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import threshold_bias
from wardline.operators import metrics
from wardline.operators.metrics import rate
from wardline.plans import registry
from wardline.settings import HEADS


def tune(validation: DataFrame) -> DataFrame:
    """``head, threshold, bias, f1`` from scored validation rows (``label`` and a probability per head); one row a head that
    has rows. ``bias`` is the logit of the threshold: taken off a head's logit, the threshold becomes 0.5."""
    return metrics.tune_thresholds(metrics.per_head(validation)).withColumn("bias", threshold_bias(F.col("threshold")))


def measure(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``head, n, n_pos, f1`` of scored rows with a threshold per head, 0 where F1 is undefined. ``thresholds`` has a row a head."""
    judged = metrics.per_head(rows).join(F.broadcast(thresholds.select("head", "threshold")), "head").withColumn(
        "hit", F.col("p") >= F.col("threshold"))
    counts = judged.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("y").alias("n_pos"), F.count_if(F.col("hit")).alias("_hits"),
        F.count_if(F.col("hit") & F.col("y")).alias("_tp"),
    )
    f1 = F.coalesce(rate(2 * F.col("_tp"), F.col("_hits") + F.col("n_pos")), F.lit(0.0))
    return counts.select("head", "n", "n_pos", f1.alias("f1"))


def write_tuned(
    terms: DataFrame, root: str, version: str, intercepts: dict[str, float], tuned: DataFrame, metadata: dict | None = None
) -> dict[str, float]:
    """Write a version whose intercepts carry the tuned biases, so that 0.5 is every head's threshold wherever it scores.

    ``thresholds`` and ``logit_bias`` stand in the metadata; a head without validation rows keeps 0.5 and no bias. Returns
    the biases.
    """
    # One row a head.
    thresholds = {h: 0.5 for h in HEADS} | {r["head"]: r["threshold"] for r in tuned.select("head", "threshold").collect()}
    biases = {h: math.log(t / (1.0 - t)) for h, t in thresholds.items()}
    shifted = {h: intercepts[h] - biases[h] for h in intercepts}
    registry.write_version(terms, root, version, shifted, {**(metadata or {}), "thresholds": thresholds, "logit_bias": biases})
    return biases
