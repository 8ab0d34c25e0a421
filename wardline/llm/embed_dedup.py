"""Near-duplicate embeddings by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need, shuffle_partitions
from wardline.llm.components import components, star_edges
from wardline.llm.vectors import distinct_vectors, pick_vectors

THRESHOLD, PASSES, WINDOW, KEY_BITS = 0.9, 24, 32, 48
#: Rows of one side of a block when the members of a component are compared.
BLOCK = 1024


def planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((passes * KEY_BITS, dim))


def sort_keys(unit: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """(rows, passes): the signs of ``KEY_BITS`` random projections a pass, concatenated to one whole number."""
    bits = (unit @ planes(unit.shape[1], passes, seed).T > 0).reshape(len(unit), passes, KEY_BITS)
    return bits @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def windowed(unit: np.ndarray, new: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i before j by at most ``window`` places, ``new[i, j distance]`` implied, with cosine >= threshold."""
    left, right = [], []
    for step in range(1, min(window, len(unit) - 1) + 1):
        hit = np.flatnonzero(np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= threshold)
        hit = hit[new[hit] != new[hit + step]] if new is not None else hit
        left.append(hit)
        right.append(hit + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long little-endian double vectors as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def pass_links(vectors: DataFrame, passes: int, window: int, threshold: float, seed: int) -> DataFrame:
    """Star links ``a, b`` of all passes. ``vectors``: ``rid, dim, unit`` (binary doubles), distinct.

    All passes are one range partitioning by (dimension, pass, key, id): the id splits runs of equal keys. Inside a
    partition every row meets the ``window`` rows after it; the ends of neighbouring partitions meet in a second, small step.
    """
    spark = vectors.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 2048):
                    some = at[i:i + 2048]
                    units = batch.column(2).take(pa.array(some))
                    keys = sort_keys(matrix(units), passes, seed)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(some), dim, np.int32)), pa.array(np.full(len(some), p, np.int32)),
                            pa.array(keys[:, p]), pa.array(rid[some]), units], ["dim", "pass", "key", "rid", "unit"])

    rows = vectors.select("rid", "dim", "unit").mapInArrow(keyed, "dim int, pass int, key long, rid long, unit binary")
    parts = shuffle_partitions(spark)
    order = rows.repartitionByRange(parts, "dim", "pass", "key", "rid").sortWithinPartitions("dim", "pass", "key", "rid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, first, seen = TaskContext.get().partitionId(), None, True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            old = 0 if tail is None else tail.num_rows
            yield from _links(table, old, window, threshold)
            if first or seen < window:  # the first rows of this partition, for the end of the one before
                yield _ends(batch.slice(0, max(0, window - seen)), part - 1, 1)
            first, seen = False, seen + batch.num_rows
            tail = table.slice(max(0, table.num_rows - window))
        if tail is not None:
            yield _ends(tail, part, 0)

    found = cut(order.mapInArrow(compare, "a long, b long, edge int, side int, dim int, pass int, rid long, unit binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                table = pa.RecordBatch.from_struct_array(rows.values)
                yield from _links(table, 0, window, threshold, table.column("side").to_numpy())

    ends = F.array_sort(F.collect_list(F.struct("side", "dim", "pass", "place", "rid", "unit")))
    edges = found.where("edge is not null").withColumn("place", F.col("a"))
    met = edges.groupBy("edge").agg(ends.alias("rows")).where(F.size("rows") > 1).select("rows").mapInArrow(
        meet, "a long, b long, edge int, side int, dim int, pass int, rid long, unit binary")
    return found.where("edge is null").select("a", "b").unionByName(met.select("a", "b"))


_NAMES = ["a", "b", "edge", "side", "dim", "pass", "rid", "unit"]


def _links(table: pa.RecordBatch, old: int, window: int, threshold: float, side=None) -> Iterator[pa.RecordBatch]:
    """Verified links of sorted rows; pairs among the first ``old`` rows are known already, ``side`` asks for mixed pairs."""
    dims, passes = table.column("dim").to_numpy(), table.column("pass").to_numpy()
    rid = table.column("rid").to_numpy()
    change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(passes) != 0)) + 1
    a, b = [], []
    for run in np.split(np.arange(len(rid)), change):
        if len(run) < 2:
            continue
        unit = matrix(table.column("unit").slice(run[0], len(run)))
        i, j = windowed(unit, None if side is None else side[run], window, threshold)
        fresh = run[j] >= old
        a.append(rid[run[i[fresh]]])
        b.append(rid[run[j[fresh]]])
    if a and sum(map(len, a)):
        node, root = star_edges(np.concatenate(a), np.concatenate(b))
        none32 = lambda: pa.nulls(len(node), pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(node), pa.array(root), none32(), none32(), none32(), none32(), pa.nulls(len(node), pa.int64()),
            pa.nulls(len(node), pa.binary())], _NAMES)


def _ends(rows: pa.RecordBatch, edge: int, side: int) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(n)), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, side, np.int32)),
        rows.column("dim"), rows.column("pass"), rows.column("rid"), rows.column("unit")], _NAMES)


def block_pairs(members: DataFrame, block: int, key: str = "root", row: str = "node") -> DataFrame:
    """``members`` with ``i, j, left, right``: every pair of a group's rows meets in one (group, i, j), i <= j.

    A group of m rows is hashed into ceil(m / block) blocks; a row is in as many (i, j), so a group within one block is
    copied once and larger ones grow by their number of blocks, not by pairs.
    """
    sizes = members.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    own = members.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(row), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return own.withColumn("other", other).select(
        *members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))


def component_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact link counts inside components. ``rows``: ``root, node, weight, unit`` -> ``node, links`` (links weighed by copies)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, links = [], []
            for cell in batch.column(0):
                t = pa.RecordBatch.from_struct_array(cell.values)
                unit, weight, node = matrix(t.column("unit")), t.column("weight").to_numpy(), t.column("node").to_numpy()
                left, right = (t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
                hit = unit[left] @ unit[right].T >= threshold
                hit &= node[left][:, None] != node[right][None, :]
                nodes.append(node[left])
                links.append(hit @ weight[right])
                if not (left & right).all():  # two different blocks: the right rows gain too
                    nodes.append(node[right])
                    links.append(hit.T @ weight[left])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links).astype(np.int64))],
                                             ["node", "links"])

    paired = block_pairs(rows, BLOCK)
    cells = paired.groupBy("root", "i", "j").agg(F.collect_list(F.struct("node", "weight", "unit", "left", "right")).alias("rows"))
    return cells.select("rows").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, passes: int = PASSES,
    window: int = WINDOW, seed: int = 5,
) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Equal vectors are one class with members, so a third of all rows with one vector is one row in the passes. Each pass
    sorts the classes by concatenated random hashes and verifies windows of neighbours; the verified pairs of all passes
    are united. A window cannot hold a large group of near copies, so the members of each united component are then compared
    block by block: every link inside a component is counted, whatever its size.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and stay (n_links 0). So do rows with
    a null id, whose component is null. Repeated rows are copies of each other; different vectors with one id are one node. Vectors of different length never link.
    """
    need(vectors, [id, vector])
    rows = pick_vectors(vectors, id, vector)
    classes, member = distinct_vectors(rows)
    united = components(pass_links(classes, passes, window, threshold, seed))
    inside = united.unionByName(united.select(F.col("root").alias("node"), "root").distinct())
    full = inside.join(classes.select(F.col("rid").alias("node"), "weight", "unit"), "node")
    links = component_links(full, threshold)
    per_class = classes.select("digest", "rid", "weight").join(united.withColumnRenamed("node", "rid"), "rid", "left").join(
        links.withColumnRenamed("node", "rid"), "rid", "left").select(
        "digest", F.coalesce("root", "rid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = member.join(per_class, "digest").select("id", "n_links", "component_id")
    alone = rows.where("unit is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
