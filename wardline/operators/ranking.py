"""Exact rank statistics without sorting a group in one task.

Values are reduced to a histogram of distinct values, the histogram is cut into cells of about equal size at points that a
mergeable sketch of the values themselves gives, cell totals (few) are prefix-summed, and ranks inside a cell are found cell
by cell. The result is exact whatever the sketch says; the cells only spread the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.numbers import rounded
from wardline.operators.blocks import not_above, same_keys

#: Cells a group, and how exact the sketch is: ranks are off by at most 1 / ACCURACY of the distinct values.
CELLS, ACCURACY = 256, 4096


def cell_cuts(histogram: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``_key0 .., _cuts``: per group, up to ``CELLS - 1`` values that cut its distinct values into cells of equal size."""
    points = [i / CELLS for i in range(1, CELLS)]
    sketch = F.array_distinct(F.percentile_approx(value, points, ACCURACY))
    return histogram.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(sketch.alias("_cuts"))


def cumulative(
    df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Per distinct value: each measure's sum at the value and, as ``<m>_before``, over all earlier values.

    Four shuffles: the histogram, the sketch, the cells and their totals. Cuts and totals are at most ``CELLS`` numbers a
    group and meet the histogram by a join that AQE turns into a broadcast while they are small.
    """
    histogram = df.groupBy(*keys, value).agg(*[m.alias(name) for name, m in measures.items()])
    others = [f"_key{i}" for i in range(len(keys))]
    cuts = cell_cuts(histogram, keys, value)
    direction = F.desc if descending else F.asc
    placed = histogram.join(cuts, same_keys(histogram, cuts, keys, others), "left").withColumn(
        "_cell", F.coalesce(not_above(F.col("_cuts"), F.col(value), 10), F.lit(0))
    ).drop("_cuts", *others)
    cell = Window.partitionBy(*keys, "_cell")
    ordered = cell.orderBy(direction(value))
    inside = placed.withColumns({
        **{f"_{m}_upto": F.sum(m).over(ordered.rowsBetween(Window.unboundedPreceding, -1)) for m in measures},
        **{f"_{m}_cell": F.sum(m).over(cell) for m in measures},
        "_first": F.row_number().over(ordered) == 1,
    })
    before = Window.partitionBy(*others).orderBy(direction("_of")).rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.where("_first").select(
        *[F.col(k).alias(o) for k, o in zip(keys, others)], F.col("_cell").alias("_of"), *[f"_{m}_cell" for m in measures]
    )
    offsets = totals.select(
        *others, "_of", *[F.coalesce(F.sum(f"_{m}_cell").over(before), F.lit(0)).alias(f"_{m}_off") for m in measures]
    )
    found = inside.drop("_first", *[f"_{m}_cell" for m in measures])
    return (
        found.join(offsets, same_keys(found, offsets, keys, others) & (found["_cell"] == offsets["_of"]))
        .withColumns({f"{m}_before": F.col(f"_{m}_off") + F.coalesce(F.col(f"_{m}_upto"), F.lit(0)) for m in measures})
        .drop("_cell", "_of", *others, *[f"_{m}_off" for m in measures], *[f"_{m}_upto" for m in measures])
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """A20. Linearly interpolated percentiles ``p50, p95, ..`` per key, rounded to 3 decimals."""
    given = list(keys)
    present = df.where(F.col(value).isNotNull())
    if not given:
        present = present.withColumn("_all", F.lit(0))
    keys = given or ["_all"]
    ranked = cumulative(present, keys, value, {"n": F.count(F.lit(1))})
    totals = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    joined = ranked.join(totals, keys)

    def at(rank: Column) -> Column:
        holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(holds, F.col(value)))

    picks, out = [], []
    for q in points:
        name = f"p{round(q * 100)}"
        place = F.lit(float(q)) * (F.col("total") - 1)
        picks += [
            at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi"),
            F.max(place - F.floor(place)).alias(f"_{name}_w"),
        ]
        lo, hi, w = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_w")
        # Interpolate from the nearer end, as numpy does.
        between = F.when(w < 0.5, lo + (hi - lo) * w).otherwise(hi - (hi - lo) * (1 - w))
        out.append(rounded(between, 3).alias(name))
    return joined.groupBy(*keys).agg(F.max("total").alias("n"), *picks).select(*given, "n", *out)
