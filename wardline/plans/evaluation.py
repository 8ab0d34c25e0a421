"""L6, L7 and the evaluation report: score once, then aggregate every section from the scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.perturb import PERTURBATIONS
from wardline.operators import corpus, metrics
from wardline.operators.guard import PATTERN_CHECKS, any_match, detect
from wardline.operators.linear_scorer import load_linear, with_linear_scores
from wardline.plans.lineage import cut
from wardline.plans.registry import Model
from wardline.settings import HEADS
from wardline.sources.chat import metrics_long


def score_rows(rows: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """L6. Rows plus ``<head>.., top_p, ml, regex``, in place: no shuffle."""
    scored = with_linear_scores(rows, load_linear(model.terms, model.intercepts), text)
    matched = detect(scored, text).drop("_norm")
    regex = any_match()
    return matched.withColumns({
        "regex": regex, "top_p": F.greatest(*[F.col(h) for h in HEADS]), "ml": metrics.any_head(threshold),
    }).drop(*[f"{c}_match" for c in PATTERN_CHECKS])


def perturbed(rows: DataFrame, text: str = "text", original: bool = True) -> DataFrame:
    """J6. One row per rewrite (and the original), as an exploded array: no join."""
    rewrites = {**({"original": lambda t: t} if original else {}), **PERTURBATIONS}
    sides = F.array(*[
        F.struct(F.lit(name).alias("perturbation"), fn(F.col(text)).alias("_rewritten")) for name, fn in rewrites.items()
    ])
    return rows.select("*", F.inline(sides)).withColumn(text, F.col("_rewritten")).drop("_rewritten")


def robustness(scored: DataFrame) -> DataFrame:
    """A18. Block rate per rewrite for the classifier and for both detectors together."""
    return scored.groupBy("perturbation").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("ml").cast("double")).alias("ml_block_rate"),
        F.avg((F.col("ml") | F.col("regex")).cast("double")).alias("regex_plus_ml_block_rate"),
    )


def adversarial_catches(scored: DataFrame) -> DataFrame:
    """A19. How many paraphrased attacks each detector set catches."""
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ml").alias("ml_caught"), F.count_if("regex").alias("regex_caught"),
        F.count_if(F.col("ml") | F.col("regex")).alias("regex_plus_ml_caught"),
    )


def adversarial_rows(scored: DataFrame, *keep: str) -> DataFrame:
    """A19. Each paraphrased attack with the verdict of either detector and of both."""
    return scored.select(*keep, "ml", "regex", (F.col("ml") | F.col("regex")).alias("regex_plus_ml"))


def benchmark_report(bench_rows: DataFrame, model: Model, threshold: float) -> tuple[DataFrame, DataFrame]:
    """L7. ``(scores by bench and detector, accuracy by category)`` for a model, current or pinned."""
    scored = cut(score_rows(bench_rows, model, threshold).select("bench", "category", "is_attack", "ml", "regex"))
    sides = F.array(
        F.struct(F.lit("ml_only").alias("detector"), F.col("ml").alias("blocked")),
        F.struct(F.lit("guard").alias("detector"), (F.col("ml") | F.col("regex")).alias("blocked")),
    )
    by_detector = scored.select("bench", "category", "is_attack", F.inline(sides))
    return (
        metrics.benchmark_score(by_detector),
        metrics.accuracy_by_category(by_detector, ["bench", "detector", "category"]),
    )


def evaluation_report(
    examples: DataFrame, prompts: DataFrame, adversarial: DataFrame, model: Model, threshold: float = 0.5, seed: int = 42
) -> DataFrame:
    """Long metrics table ``version, section, slice, metric, value`` (S12) of one model.

    ``examples`` are the deduplicated training examples; the held-out part is found again by hash.
    """
    held_out = corpus.with_split(examples, seed=seed).where("split = 'test'")
    scored = cut(score_rows(held_out, model, threshold)).withColumns(
        {"blocked": F.col("ml"), "is_attack": F.col("label") != "safe"}
    )
    heads = metrics.per_head(scored)
    gate = cut(score_rows(prompts, model, threshold)).withColumn(
        "is_attack", F.col("label") != "safe"
    )
    rewritten = perturbed(prompts.where("label <> 'safe'"))
    version = model.version
    sections = [
        metrics_long(metrics.head_metrics(heads, threshold), version, "heads", ["head"]),
        metrics_long(metrics.ranking_quality(heads), version, "ranking", ["head"]),
        metrics_long(metrics.confusion(scored), version, "block_decision", []),
        metrics_long(metrics.recall_by_class(scored), version, "recall_by_class", ["label"]),
        metrics_long(metrics.threshold_sweep(scored), version, "threshold_sweep", ["threshold"]),
        metrics_long(metrics.detector_comparison(gate), version, "eval_set", ["detector"]),
        metrics_long(metrics.detector_recall(gate), version, "eval_set_recall", ["detector", "label"]),
        metrics_long(robustness(score_rows(rewritten, model, threshold)), version, "robustness", ["perturbation"]),
        metrics_long(
            adversarial_catches(score_rows(adversarial, model, threshold)), version, "adversarial", [],
        ),
        metrics_long(
            metrics.drift_warning(scored.agg(F.count(F.lit(1)).alias("n_test")), model.metadata.get("n_test", 0)),
            version, "drift", [],
        ),
    ]
    report = sections[0]
    for more in sections[1:]:
        report = report.unionByName(more)
    return report
