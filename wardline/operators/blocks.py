"""Bounded-frame windows that survive a hot key.

Window functions put a whole key in one task. When every frame looks back over a bounded number of rows, a long key can
instead be cut into blocks of its order column, each block carrying along the few earlier rows its frames can see. Short keys
(the usual case) keep a single exchange and no copies. The layout of long keys is part of the lazy plan: nothing runs while
the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
OWN = "_own"
BASE = "_base"
HOT = "_hot"
DEFAULT_BLOCK_ROWS = 100_000
#: Cut points are taken from a hash sample of about so many rows a block.
SAMPLED = 16


def not_above(values: Column, order: Column, bits: int = 24) -> Column:
    """How many of the sorted ``values`` (fewer than ``2 ** bits``) are at most ``order``, by binary search; null for no array."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(bits))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step - 1) <= order, at + step).otherwise(at)
    )
    return F.when(values.isNotNull(), found)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], others: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    condition = F.lit(True)
    for key, other in zip(keys, others):
        condition = condition & left[key].eqNullSafe(right[other])
    return condition


def cut_points(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """``keys, _cuts``: where the blocks of each long key begin, but for its first; no row for short keys.

    The orders are sampled by hash, about ``SAMPLED`` a block, and every ``SAMPLED``-th one is a cut, so blocks hold about
    ``block_rows`` rows whatever the distribution of the orders.
    """
    rate = max(1, block_rows // SAMPLED)
    per = max(1, block_rows // rate)
    sampled = df.where(F.pmod(F.xxhash64(*keys, order), F.lit(rate)) == 0).select(*keys, order).distinct()
    ranked = sampled.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    cuts = ranked.where((F.col("_rank") > 0) & (F.col("_rank") % per == 0))
    return cuts.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("_cuts"))


def layout(df: DataFrame, keys: Sequence[str], order: str, block_rows: int, lookback: int) -> DataFrame:
    """``_key0 .., _cuts, _blocks`` of the long keys: per block where it begins, how many rows of its key come before
    it, and from which order on it reads earlier rows (null: from the first).

    A two-level rank: blocks are counted (map-side), the counts are summed up along each key, and the row that lies
    ``lookback`` before a block is found by its rank inside its own block. Three numbers stand here for about ``block_rows``
    rows of input, so the result is small enough to broadcast.
    """
    others = [f"_key{i}" for i in range(len(keys))]
    cuts = cut_points(df, keys, order, block_rows).select(*[F.col(k).alias(o) for k, o in zip(keys, others)], "_cuts")
    slim = df.select(*keys, order)
    long_rows = slim.join(F.broadcast(cuts), same_keys(slim, cuts, keys, others)).select(
        *others, F.col(order).alias("_order"), not_above(F.col("_cuts"), F.col(order)).alias(BLOCK)
    )
    counts = long_rows.groupBy(*others, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*others).orderBy(BLOCK)
    bases = counts.withColumn(
        BASE, F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = long_rows.withColumn("_i", F.row_number().over(Window.partitionBy(*others, BLOCK).orderBy("_order")))
    at = bases.select(*[F.col(o).alias(f"{o}b") for o in others], F.col(BLOCK).alias("_of"), F.col(BASE).alias("_before"))
    renamed = [f"{o}b" for o in others]
    places = inside.join(F.broadcast(at), same_keys(inside, at, others, renamed) & (inside[BLOCK] == at["_of"])).select(
        *others, "_order", (F.col("_before") + F.col("_i") + lookback - 1).alias("_seen_from")
    )
    starts = bases.select(*[F.col(o).alias(f"{o}b") for o in others], F.col(BLOCK).alias("_of"), F.col(BASE).alias("_before"))
    firsts = places.join(F.broadcast(starts), same_keys(places, starts, others, renamed) & (places["_seen_from"] == starts["_before"])).select(
        *others, F.col("_of").alias(BLOCK), F.col("_order").alias("_from")
    )
    rows = bases.alias("b").join(
        firsts.alias("f"), F.expr(" AND ".join(f"b.{c} <=> f.{c}" for c in (*others, BLOCK))), "left"
    ).select(*[f"b.{o}" for o in others], f"b.{BLOCK}", f"b.{BASE}", "f._from")
    blocks = F.array_sort(F.collect_list(F.struct(BLOCK, BASE, "_from")))
    per_key = rows.groupBy(*others).agg(blocks.alias("_blocks"))
    cuts_again = cuts.select(*[F.col(o).alias(f"{o}b") for o in others], "_cuts")
    return per_key.join(cuts_again, same_keys(per_key, cuts_again, others, renamed)).select(*others, "_cuts", "_blocks")


def place(
    df: DataFrame, keys: Sequence[str], order: str, lookback: int, block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Add block columns; windows over ``keys + [_block]`` then equal windows over ``keys``.

    Rows with ``_own`` false are copies that only feed frames and must be dropped afterwards: the last ``lookback`` rows before
    a block. ``order`` is anything that can be sorted; rows of equal order share a block, and their copies too.
    """
    plan = layout(df, keys, order, block_rows, lookback)
    others = [f"_key{i}" for i in range(len(keys))]
    joined = df.join(F.broadcast(plan), same_keys(df, plan, keys, others), "left")
    blocks = F.col("_blocks")
    own = F.coalesce(not_above(F.col("_cuts"), F.col(order)), F.lit(0)).cast("long")
    # A block reads this row when the row lies behind the order from which it reads; such blocks follow one another.
    read = F.filter(
        F.slice(blocks, F.col(BLOCK).cast("int") + 2, max(lookback, 1)),
        lambda b: b["_from"].isNull() | (b["_from"] <= F.col(order)),
    )
    targets = F.when(
        F.col("_blocks").isNotNull(),
        F.concat(
            F.array(F.struct(F.col(BLOCK).alias("block"), F.get(blocks, F.col(BLOCK).cast("int"))[BASE].alias("base"))),
            F.transform(read, lambda b: F.struct(b[BLOCK].cast("long").alias("block"), b[BASE].alias("base"))),
        ),
    ).otherwise(F.array(F.struct(F.col(BLOCK).alias("block"), F.lit(0).cast("long").alias("base"))))
    return (
        joined.withColumn(BLOCK, own)
        .withColumn(HOT, F.col("_blocks").isNotNull())
        .withColumn("_target", F.explode(targets))
        .withColumn(OWN, F.col("_target")["block"] == F.col(BLOCK))
        .withColumn(BASE, F.col("_target")["base"])
        .withColumn(BLOCK, F.col("_target")["block"])
        .drop("_target", "_cuts", "_blocks", *others)
    )


def position(keys: Sequence[str], order: str) -> Column:
    """1-based row number within the key, right for own rows and copies alike: copies stand before the block's first row."""
    whole = Window.partitionBy(*keys, BLOCK)
    copies = F.count(F.when(~F.col(OWN), F.lit(1))).over(whole)
    return (F.col(BASE) - copies + F.row_number().over(whole.orderBy(order))).cast("long")


def with_earlier_min(inside: DataFrame, own: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """``out``, a block's smallest ``value`` so far, lowered to the smallest of the key's earlier blocks.

    ``own`` holds the own rows of long keys; per block they come down to one row.
    """
    per_block = own.groupBy(*keys, BLOCK).agg(F.min(value).alias("_low"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    others = [f"_key{i}" for i in range(len(keys))]
    before = per_block.select(
        *[F.col(k).alias(o) for k, o in zip(keys, others)], F.col(BLOCK).alias("_of"),
        F.min("_low").over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
    )
    return (
        inside.join(F.broadcast(before), same_keys(inside, before, keys, others) & (inside[BLOCK] == before["_of"]), "left")
        .withColumn(out, F.least(F.col(out), F.col("_before")))
        .drop("_before", "_of", *others)
    )
