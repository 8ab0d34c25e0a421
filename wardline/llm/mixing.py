"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import cut, hex_number, need

WORD = r"[^\x20\x09-\x0D]+"
#: A cell of documents is ranked by one task. One with more rows is cut along the order that holds inside it, so that the
#: number changes tasks and never the result.
CELL_ROWS = 50_000
#: Documents above this part of their source are ranked apart, so that one of them cannot spoil its source's total.
LARGE_PART = 50
CELL = ("mix_key", "mix_class", "mix_bucket")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, ceiling: int) -> DataFrame:
    """``(skey, source_size)`` -> ``target``: weights by order of ``skey``, repeating; the total is ``share`` of all sizes;
    no target above ``ceiling`` times its source, the excess shared again by weight.

    The fixed point in one step: sources hit their ceiling in the order of size / weight, and the first one that stays
    below it sets the words per unit of weight. There is one row per source here, so the two windows without a key are small.
    """
    order = Window.orderBy("skey")
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", pick.cast("long")).withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "below": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(after),
    })
    rows = rows.withColumn("unit", (F.col("total") - ceiling * F.col("below")) / F.col("weight_left"))
    rows = rows.withColumn("place", F.row_number().over(fill))
    below = F.col("unit") * F.col("weight") <= ceiling * F.col("source_size")
    open_unit = F.min(F.when(below, F.struct("place", "unit"))).over(everything)["unit"]
    return rows.select("skey", "source_size", F.least(
        (F.lit(1.0) * ceiling * F.col("source_size")), F.coalesce(open_unit * F.col("weight"), F.lit(1.0) * ceiling * F.col("source_size"))
    ).alias("target"))


def counted(sized: DataFrame) -> DataFrame:
    """Cells with their rows, words and smallest size; few next to the documents."""
    return cut(sized.groupBy(*CELL).agg(F.count("*").alias("rows"), F.sum("mix_size").alias("words"), F.min("mix_size").alias("least")))


def finer(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """``sized`` with a ``mix_bucket`` in the cells of over ``CELL_ROWS``: the exact size, then as many leading bits of the
    hash as its rows need. Buckets follow (size, hash), so ranks stay what they were."""
    crowded = cells.where(F.col("rows") > CELL_ROWS).select("mix_key", "mix_class", F.lit(True).alias("mix_crowded"))
    sized = sized.join(F.broadcast(crowded), ["mix_key", "mix_class"], "left")
    equal = cut(sized.where("mix_crowded").groupBy("mix_key", "mix_size").count().where(F.col("count") > CELL_ROWS).select(
        "mix_key", "mix_size", F.least(F.length(F.bin(F.floor(F.col("count") / CELL_ROWS))), F.lit(32)).alias("mix_bits")))
    sized = sized.join(F.broadcast(equal), ["mix_key", "mix_size"], "left")
    prefix = F.coalesce(F.expr("shiftright(mix_hash, 32 - mix_bits)"), F.lit(0))
    return sized.withColumn("mix_bucket", F.when(
        F.col("mix_crowded"), F.col("mix_size") * (1 << 32) + prefix).otherwise(F.col("mix_bucket"))).drop("mix_crowded", "mix_bits")


def mix(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5, ceiling: int = 2, seed: str = "mix",
) -> DataFrame:
    """Every row with ``mix_size, mix_source_size, mix_target, mix_copies``: how often the mix takes it.

    Documents of a source are ordered by size and hash; each adds its expected copies to a running sum; one random offset
    per source is added, and a document is emitted once for each whole number that its step crosses. Equal sizes stand
    together, so the words taken follow the copies taken. The few documents that hold over 1/50 of their source are
    walked first, and the rest share what is then left of the target.

    The running sum is a rank: (source, size class) cells are counted, their counts are added up per source, and only then
    rows are numbered inside their cell, so a source with a third of all rows is many tasks. A cell of over ``CELL_ROWS`` is
    cut by exact size and then by the hash's leading bits, in the order of the rows: the order is one at every size.

    Null text counts 0 words, a null source is a source of its own (last), null ids are allowed, repeated rows are separate
    documents, other columns pass through unchanged (columns called ``mix_*`` are replaced). An empty table gives none.
    """
    need(docs, [id, text, source])
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("mix_")])
    sized = docs.withColumns({
        "mix_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "mix_key": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t")),
        "mix_hash": hex_number(F.coalesce(F.col(id).cast("string"), F.lit(""))),
        "mix_tie": F.xxhash64(F.col(text)),
    })
    bits = F.bin("mix_size")
    sized = sized.withColumn("mix_class", F.concat(F.lpad(F.length(bits), 2, "0"), F.substring(bits, 1, 4)))

    sized = sized.withColumn("mix_bucket", F.lit(0).cast("long"))
    cells = counted(sized)
    if cells.where(F.col("rows") > CELL_ROWS).limit(1).count():
        sized = finer(sized, cells)
        cells = counted(sized)

    totals = cells.groupBy(F.col("mix_key").alias("skey")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, ceiling).withColumnRenamed("skey", "mix_key")
    in_class = Window.partitionBy("mix_key", "mix_class")
    cells = cells.join(targets, "mix_key").withColumn(
        "large", F.min("least").over(in_class) * LARGE_PART > F.col("source_size"))
    in_order = Window.partitionBy("mix_key", "large").orderBy("mix_class", "mix_bucket")
    cells = cut(cells.withColumns({
        "first": F.sum("rows").over(in_order) - F.col("rows"),
        "ratio": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
        "offset": hex_number(F.concat(F.lit(f"{seed}|"), "mix_key")) / F.lit(float(1 << 32)),
    }))
    # From here on every helper column is called mix_*, as the rows carry the caller's columns.
    keys = list(CELL)
    step, at, offset = F.col("mix_ratio"), F.col("mix_place"), F.col("mix_offset")
    copies = F.floor(step * at + offset) - F.floor(step * (at - 1) + offset)
    inside = Window.partitionBy(*keys).orderBy("mix_size", "mix_hash", F.col(id), "mix_tie")

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        rows = rows.join(of, keys)
        return rows.withColumn("mix_place", F.col("mix_first") + F.row_number().over(inside)).withColumn("mix_copies", copies)

    of = cells.select(*keys, *[F.col(c).alias(f"mix_{c}") for c in ("first", "ratio", "offset", "large", "source_size", "target")])
    slim = sized.select(F.col(id), "mix_tie", "mix_key", "mix_class", "mix_bucket", "mix_size", "mix_hash")
    taken = placed(slim, of.where("mix_large")).groupBy("mix_key").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"))
    rest = cells.where("not large").groupBy("mix_key").agg(F.sum("words").alias("rest"))
    left = rest.join(taken, "mix_key", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    ratio = F.when(F.col("mix_large"), step).when(F.coalesce("rest", F.lit(0)) > 0, F.greatest(
        F.lit(0.0), F.least(F.lit(float(ceiling)), (F.col("mix_target") - F.col("taken")) / F.col("rest")))).otherwise(F.lit(0.0))
    of = cut(of.join(left, "mix_key", "left").withColumn("mix_ratio", ratio).drop("taken", "rest"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    return placed(sized, of).select(*keep, "mix_size", "mix_source_size", "mix_target", F.col("mix_copies").cast("long").alias("mix_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the ``mix_*`` columns."""
    rows = mixed.where("mix_copies > 0").withColumn("mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return rows.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
