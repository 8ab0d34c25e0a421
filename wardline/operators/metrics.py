"""Detector quality: confusion, per-head scores, curves, sweeps, gates.

Inputs are scored rows ``label, <head>..``; everything is a conditional aggregate over one pass, and
what needs an order works on histograms (see ``ranking``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.numbers import fixed
from wardline.operators.ranking import cumulative
from wardline.settings import HEADS

SWEEP = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
TUNING_GRID = tuple(round(0.05 + 0.01 * i, 2) for i in range(91))


def rate(top: Column, bottom: Column) -> Column:
    """Ratio as a double, null when the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def any_head(threshold: float, heads: Sequence[str] = HEADS) -> Column:
    """A6. Blocked when some head reaches the threshold."""
    return F.greatest(*[F.col(h) for h in heads]) >= threshold


def confusion(rows: DataFrame, blocked: str = "blocked", attack: str = "is_attack", by: Sequence[str] = ()) -> DataFrame:
    """A7, A8, L5. Counts and block-decision metrics; a metric over an empty class is null."""
    b, a = F.col(blocked), F.col(attack)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"),
        F.count_if(~a & ~b).alias("tn"), F.count_if(a & ~b).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *by, "n", "tp", "fp", "tn", "fn",
        rate(tp + tn, F.col("n")).alias("accuracy"),
        ((rate(tp, tp + fn) + rate(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(fp, fp + tn).alias("false_positive_rate"),
    )


def per_head(rows: DataFrame, heads: Sequence[str] = HEADS, label: str = "label") -> DataFrame:
    """F7 on scored rows: ``head, p, y`` for a head's own class and safe rows, without a join."""
    sides = F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).alias("p")) for h in heads])
    return (
        rows.select(F.col(label).alias("_label"), F.inline(sides))
        .where((F.col("_label") == F.col("head")) | (F.col("_label") == "safe"))
        .select("head", "p", (F.col("_label") == F.col("head")).alias("y"))
    )


def head_metrics(head_rows: DataFrame, threshold: float) -> DataFrame:
    """A9. Precision, recall and F1 per head, 0 where undefined."""
    hit = F.col("p") >= threshold
    counts = head_rows.groupBy("head").agg(
        F.count_if("y").alias("n_pos"), F.count_if(F.col("y") & hit).alias("tp"),
        F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"),
    )
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return counts.select(
        "head", "n_pos",
        or_zero(rate(tp, tp + fp)).alias("precision"),
        or_zero(rate(tp, tp + fn)).alias("recall"),
        or_zero(rate(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    """A10. Mean F1 and the weakest head (the earlier head wins a tie)."""
    order = F.array_position(F.array(*[F.lit(h) for h in HEADS]), F.col("head"))
    return metrics.agg(
        F.avg("f1").alias("macro_f1"),
        F.min_by("head", F.struct(F.col("f1"), order)).alias("weakest_head"),
        F.min("f1").alias("weakest_f1"),
    )


def ranking_quality(head_rows: DataFrame, by: Sequence[str] = ("head",)) -> DataFrame:
    """A11, A12. ROC-AUC with averaged ties and step-wise average precision, exact, from score histograms."""
    by = list(by)
    ranked = cumulative(
        head_rows, by, "p", {"pos": F.count_if("y"), "neg": F.count_if(~F.col("y"))}, descending=True
    )
    pos, neg, pos_above, neg_above = (F.col(x) for x in ("pos", "neg", "pos_before", "neg_before"))
    precision_here = (pos_above + pos) / (pos_above + pos + neg_above + neg)
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(neg * (pos_above + pos / 2.0)).alias("_area"), F.sum(pos * precision_here).alias("_steps"),
    )
    return sums.select(
        *by, "n_pos", "n_neg",
        rate(F.col("_area"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
        rate(F.col("_steps"), F.col("n_pos")).alias("pr_auc"),
    )


def _grid_counts(rows: DataFrame, by: Sequence[str], p: str, y: str, grid: Sequence[float]) -> DataFrame:
    """J7. Positives and negatives at or above each grid value.

    A row is reduced to the number of grid values it reaches, rows are counted per number, and the
    counts (at most grid size + 1 per group) are summed up from the top.
    """
    points = F.array(*[F.lit(float(t)) for t in grid])
    steps = rows.withColumn("_k", F.size(F.filter(points, lambda t: t <= F.col(p))))
    counted = steps.groupBy(*by, "_k").agg(
        F.count_if(y).alias("pos"), F.count_if(~F.col(y)).alias("neg")
    )
    folded = counted.groupBy(*by).agg(
        F.collect_list(F.struct("_k", "pos", "neg")).alias("_h"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    numbered = F.transform(points, lambda t, i: F.struct(t.alias("threshold"), (i + 1).alias("_need")))

    def reached(field: str) -> Column:
        return F.aggregate(
            F.filter("_h", lambda x: x["_k"] >= F.col("_need")), F.lit(0).cast("long"), lambda acc, x: acc + x[field]
        )

    return folded.select(*by, "n_pos", "n_neg", "_h", F.inline(numbered)).select(
        *by, "n_pos", "n_neg", "threshold", reached("pos").alias("tp"), reached("neg").alias("fp")
    )


def threshold_sweep(
    rows: DataFrame, p: str = "top_p", attack: str = "is_attack", grid: Sequence[float] = SWEEP, by: Sequence[str] = ()
) -> DataFrame:
    """A13. Attack recall and false positive rate per threshold."""
    return _grid_counts(rows, by, p, attack, grid).select(
        *by, "threshold",
        rate(F.col("tp"), F.col("n_pos")).alias("attack_recall"),
        rate(F.col("fp"), F.col("n_neg")).alias("false_positive_rate"),
    )


def tune_thresholds(head_rows: DataFrame, grid: Sequence[float] = TUNING_GRID) -> DataFrame:
    """A26. Per head the grid value of largest F1; the smallest such value wins."""
    counts = _grid_counts(head_rows, ["head"], "p", "y", grid)
    f1 = F.coalesce(rate(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")), F.lit(0.0))
    return counts.withColumn("f1", f1).groupBy("head").agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1")
    )


def recall_by_class(rows: DataFrame, blocked: str = "blocked", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """A14. Share of rows blocked and size, per class (and detector, on ``unpivot_detectors``)."""
    return rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(blocked).cast("double")).alias("recall"))


def unpivot_detectors(rows: DataFrame, keep: Sequence[str], ml: str = "ml", regex: str = "regex") -> DataFrame:
    """One row per detector set: the classifier, the patterns, and both together."""
    sides = F.array(
        F.struct(F.lit("ml_only").alias("detector"), F.col(ml).alias("blocked")),
        F.struct(F.lit("regex_only").alias("detector"), F.col(regex).alias("blocked")),
        F.struct(F.lit("regex_plus_ml").alias("detector"), (F.col(ml) | F.col(regex)).alias("blocked")),
    )
    return rows.select(*keep, F.inline(sides))


def detector_comparison(rows: DataFrame, ml: str = "ml", regex: str = "regex", attack: str = "is_attack") -> DataFrame:
    """A17. Class sizes, accuracy, blocked safe rows and missed attacks per detector set; recall: ``detector_recall``."""
    b, a = F.col("blocked"), F.col(attack)
    return unpivot_detectors(rows, [attack], ml, regex).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~a).alias("n_safe"), F.count_if(a).alias("n_attack"),
        F.avg((b == a).cast("double")).alias("accuracy"),
        F.count_if(b & ~a).alias("safe_blocked"),
        F.count_if(~b & a).alias("attacks_missed"),
    )


def detector_recall(rows: DataFrame, ml: str = "ml", regex: str = "regex", label: str = "label") -> DataFrame:
    """A14, A17. Size and recall of each attack class per detector set."""
    attacks = rows.where(F.col(label) != "safe")
    return recall_by_class(unpivot_detectors(attacks, [label], ml, regex), label=label, by=["detector"])


def benchmark_score(rows: DataFrame, by: Sequence[str] = ("bench", "detector"), blocked: str = "blocked") -> DataFrame:
    """A15. Mean of attack recall and benign accuracy; recall alone for a set without benign rows."""
    a, b = F.col("is_attack"), F.col(blocked)
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a).alias("n_attack"),
        F.avg(F.when(a, b.cast("double"))).alias("attack_recall"),
        F.avg(F.when(~a, (~b).cast("double"))).alias("_benign"),
    )
    return sums.select(
        *by, "n", "n_attack", "attack_recall",
        F.coalesce((F.col("attack_recall") + F.col("_benign")) / 2, F.col("attack_recall")).alias("score"),
        (1 - F.col("_benign")).alias("false_positive_rate"),
    )


def accuracy_by_category(rows: DataFrame, by: Sequence[str] = ("bench", "category"), blocked: str = "blocked") -> DataFrame:
    """A16."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(blocked) == F.col("is_attack")).cast("double")).alias("accuracy")
    )


def misses(rows: DataFrame, text: str = "text") -> DataFrame:
    """A21. Rows whose verdict disagrees with the label (``blocked, label, top_head, top_p``)."""
    got = F.when(F.col("blocked"), F.concat(F.lit("BLOCK "), F.col("top_head"))).otherwise(F.lit("allow"))
    return rows.where(F.col("blocked") != (F.col("label") != "safe")).withColumn(
        "miss",
        F.concat(
            F.lit("expected "), F.rpad("label", 16, " "), F.lit(" got "), got,
            F.lit(" (p="), fixed(F.col("top_p"), 2), F.lit("): "), F.col(text),
        ),
    )


def quality_gate(metrics: DataFrame, eval_accuracy: DataFrame, min_f1: float, min_accuracy: float) -> DataFrame:
    """A22. ``shipped, reason`` from ``head_metrics`` and a one-row ``accuracy``; the F1 gate is named first.

    Both sides hold a single row.
    """
    both = macro_f1(metrics).join(F.broadcast(eval_accuracy.select("accuracy")), F.lit(True))
    weak = F.col("weakest_f1") < min_f1
    inaccurate = F.col("accuracy") < min_accuracy
    return both.select(
        "macro_f1", "weakest_head", "weakest_f1", F.col("accuracy").alias("eval_accuracy"),
        (~weak & ~inaccurate).alias("shipped"),
        F.when(weak, F.format_string(
            f"REJECTED: head '%s' f1 %s is below the minimum {min_f1:.3f} quality gate",
            F.col("weakest_head"), fixed(F.col("weakest_f1"), 3),
        )).when(inaccurate, F.format_string(
            f"REJECTED: eval set block accuracy %s is below the minimum {min_accuracy:.3f} quality gate",
            fixed(F.col("accuracy"), 3),
        )).otherwise(F.lit("SHIPPED")).alias("reason"),
    )


def drift_warning(n_test: DataFrame, recorded: int) -> DataFrame:
    """A27. Compare the current held-out size (one row, ``n_test``) with the one stored with the model."""
    return n_test.select(
        "n_test", F.lit(recorded).alias("recorded_n_test"),
        F.when(F.col("n_test") != recorded, F.lit(
            "held-out size differs from training; rows may overlap training data"
        )).alias("warning"),
    )
