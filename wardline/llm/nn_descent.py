"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import cut, need, release, shuffle_partitions, small_batches
from wardline.llm.vectors import distinct_vectors, pick_vectors

#: Neighbours kept a node, neighbours that take part a round and kind (new, old), and the share of changed neighbours below
#: which the rounds end.
DEGREE, SAMPLE, LEAST_CHANGE = 32, 8, 0.01
#: Starting buckets: sign codes of so many trees, of about so many nodes.
TREES, BUCKET = 2, 192
#: Search: entry nodes a band of norms and longest vectors among them, nodes expanded a query and step, candidates kept a query.
ENTRIES, EXPAND, BEAM = 256, 64, 640
#: Of the edges that lead to a node, it also gets the way back: those of the first BACK neighbours, the closest 2 * DEGREE.
BACK = 12
#: Candidates that are scored again on the original vectors: RESCORE * k, and all that come as close as float32 can tell.
RESCORE, CLOSE = 2, 1e-5
#: Cells or queries that a task works on at a time.
SLICE = 128
#: Rows that go to Python at once: in a search step a row is a node with up to 3 * DEGREE vectors.
ROWS = 512
GRAPH = "node long, vec binary, ids array<long>, sims array<float>, fresh array<boolean>"


def mix(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0)
    for p in parts:
        out = (np.asarray(p).astype(np.int64).view(np.uint64) ^ out) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(32))
    return out


def lifted(vectors: list[bytes]) -> np.ndarray:
    """Rows of unit length, see ``graph_vectors``; the band, which stands last, is left out."""
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1)[:, :-1]


def bands(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1)[:, -1]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*values, np.empty(0)]).astype(kind.to_pandas_dtype()), kind))


def graph_vectors(classes: DataFrame) -> DataFrame:
    """``node, band, vec, short``: a vector of band b has a norm of ``2 ** b`` up to ``2 ** (b + 1)``; ``short`` is its lift.

    ``vec`` holds float32: the vector over ``2 ** (b + 1)``, one more component that lifts it to length 1, and the band. Within
    a band the largest inner product with a query is then the largest cosine, neighbourhood is symmetric, and the lift never
    outweighs the vector, however far the norms of the table lie apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(batch.num_rows, -1)
            scale = np.abs(x).max(1)
            unit = x / scale[:, None]
            norm = np.sqrt(np.einsum("ij,ij->i", unit, unit))
            band = np.floor(np.log2(norm) + np.log2(scale))
            part = np.exp2(np.log2(norm) + np.log2(scale) - band - 1)  # of the band's upper end
            x = unit * (part / norm)[:, None]
            more = np.sqrt(np.maximum(0.0, 1.0 - part * part))
            rows = np.concatenate([x, more[:, None], band[:, None]], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(band.astype(np.int32)), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(more)],
                ["node", "band", "vec", "short"])

    return classes.select("rid", "raw").mapInArrow(run, "node long, band int, vec binary, short double")


def merged(ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best different ids; an id that was known before stays known."""
    order = np.lexsort((fresh, ids))
    ids, sims, fresh = ids[order], sims[order], fresh[order]
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.empty(0, bool)
    ids, sims, fresh = ids[first], sims[first], fresh[first]
    best = np.lexsort((ids, -sims))[:keep]
    return ids[best], sims[best], fresh[best]


def chosen(node: int, ids: np.ndarray, fresh: np.ndarray, round_: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the new and of the known neighbours that take part in a round; the same whenever it is computed."""
    order = np.argsort(mix(ids, node, round_), kind="stable")
    return order[fresh[order]][:sample], order[~fresh[order]][:sample]


def first_neighbours(vectors: DataFrame, sizes: dict[int, int], dim: int, degree: int, seed: int) -> DataFrame:
    """``node, b, sim`` from buckets of nodes of a band whose random projections have the same signs; large buckets are cut by
    hash. Signs are of the vectors themselves: neither norm nor lift moves them. ``sizes``: nodes of each band."""
    bits = {b: max(0, int(np.ceil(np.log2(max(1.0, n / BUCKET))))) for b, n in sizes.items()}
    most = max(bits.values())
    planes = np.random.default_rng([seed, dim]).standard_normal((TREES * most, dim - 1)).astype(np.float32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = batch.column(1).to_numpy()
            vec = lifted(batch.column(2).to_pylist())[:, :-1]
            codes = np.zeros((len(vec), TREES), np.int64)
            if most:
                sign = (vec @ planes.T > 0).reshape(len(vec), TREES, most)
                codes = (sign @ (1 << np.arange(most, dtype=np.int64))) & np.array([(1 << bits[int(b)]) - 1 for b in band])[:, None]
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([
                    batch.column(1), pa.array(np.full(len(vec), t, np.int32)), pa.array(codes[:, t].astype(np.int64)), batch.column(0),
                    batch.column(2)], ["band", "tree", "code", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                t = pa.RecordBatch.from_struct_array(cell.values)
                node, vec = t.column("node").to_numpy(), lifted(t.column("vec").to_pylist())
                if len(node) < 2:
                    continue
                for i in range(0, len(node), 1024):
                    sims = vec[i:i + 1024] @ vec.T
                    sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -np.inf
                    k = min(degree, len(node) - 1)
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(node[i:i + 1024], k)), pa.array(node[best].ravel()),
                        pa.array(np.take_along_axis(sims, best, 1).ravel())], ["node", "b", "sim"])

    coded = vectors.select("node", "band", "vec").mapInArrow(code, "band int, tree int, code long, node long, vec binary")
    parts = coded.groupBy("band", "tree", "code").agg(F.ceil(F.count("*") / F.lit(2.0 * BUCKET)).cast("int").alias("parts"))
    cells = coded.join(parts, ["band", "tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    return cells.groupBy("band", "tree", "code", "part").agg(F.collect_list(F.struct("node", "vec")).alias("rows")).select("rows").mapInArrow(
        compare, "node long, b long, sim float")


def merge_into(graph: DataFrame, proposals: DataFrame, degree: int, round_: int, sample: int, new: Accumulator) -> DataFrame:
    """The graph with the best of its neighbours and ``proposals`` (``node, b, sim``); those that took part are known now.
    ``new`` gets the number of neighbours that are not."""
    best = Window.partitionBy("node").orderBy(F.col("sim").desc(), "b")
    # dense_rank: equal proposals count once. Its group limit also applies before the shuffle, so a node that everyone
    # proposes to is cut down where the proposals are made.
    kept = proposals.withColumn("rank", F.dense_rank().over(best)).where(F.col("rank") <= degree)
    gathered = kept.groupBy("node").agg(F.collect_set(F.struct("b", "sim")).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, ids, sims, fresh, more in zip(*(batch.column(i) for i in (0, 2, 3, 4, 5))):
                a, s, f = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (ids, sims, fresh))
                if round_ >= 0 and len(a):
                    f = f.copy()
                    f[chosen(node.as_py(), a, f, round_, sample)[0]] = False
                if more.is_valid:
                    t = more.values
                    a = np.concatenate([a, t.field("b").to_numpy()])
                    s = np.concatenate([s, t.field("sim").to_numpy()])
                    f = np.concatenate([f, np.ones(len(t), bool)])
                out.append(merged(a.astype(np.int64), s.astype(np.float32), f.astype(bool), degree))
            new.add(int(sum(o[2].sum() for o in out)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), lists([o[0] for o in out], pa.int64()), lists([o[1] for o in out], pa.float32()),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(o[2]) for o in out])]).astype(np.int32),
                                         pa.array(np.concatenate([*[o[2] for o in out], np.empty(0, bool)]).astype(bool)))],
                ["node", "vec", "ids", "sims", "fresh"])

    return graph.join(gathered, "node", "left").select("node", "vec", "ids", "sims", "fresh", "more").mapInArrow(run, GRAPH)


def first_of(order: np.ndarray, n: int, *groups: np.ndarray) -> np.ndarray:
    """Places of each group's first ``n`` rows by ``order``."""
    at = np.lexsort((order, *groups))
    change = np.zeros(len(at), bool)
    change[:1] = True
    for g in groups:
        change[1:] |= g[at[1:]] != g[at[:-1]]
    begin = np.flatnonzero(change)
    return at[np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)])) < n]


def neighbour_pairs(graph: DataFrame, degree: int, round_: int, sample: int) -> DataFrame:
    """One round's local joins: ``node, b, sim`` for neighbours of a common neighbour, where they beat what a node has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        via, node, draw, new = [], [], [], []
        for batch in batches:
            for own, drawn, ids, draws, fresh in zip(*(batch.column(i).to_pylist() for i in (0, 1)), *(batch.column(i) for i in (2, 3, 4))):
                a, d, f = ids.values.to_numpy(), draws.values.to_numpy(), fresh.values.to_numpy(zero_copy_only=False)
                for places, flag in zip(chosen(own, a, f, round_, sample), (True, False)):
                    via += [np.full(len(places), own), a[places]]
                    node += [a[places], np.full(len(places), own)]
                    draw += [d[places], np.full(len(places), drawn)]
                    new.append(np.full(2 * len(places), flag))
        if not via:
            return
        via, node, draw, new = np.concatenate(via), np.concatenate(node), np.concatenate(draw), np.concatenate(new)
        # A node that everyone knows is cut down before the shuffle; what a task holds for that is 25 bytes a row.
        kept = first_of(draw, 2 * sample, new, via)
        for i in range(0, len(kept), 1 << 16):
            at = kept[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(via[at]), pa.array(node[at]), pa.array(draw[at]), pa.array(new[at])], ["via", "node", "draw", "fresh"])

    drawn = lambda c: F.xxhash64(c, F.lit(round_))
    some = graph.select("node", drawn(F.col("node")), "ids", F.transform("ids", drawn), "fresh").mapInArrow(
        send, "via long, node long, draw long, fresh boolean")
    worst = F.when(F.size("sims") >= degree, F.element_at("sims", -1)).otherwise(F.lit(-2.0).cast("float"))
    full = some.join(graph.select("node", "vec", worst.alias("worst")), "node").groupBy("via").agg(
        F.collect_list(F.struct("node", "draw", "fresh", "worst", "vec")).alias("rows")).select("rows")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield joined(batch.slice(at, SLICE).column(0))

    def joined(cells) -> pa.RecordBatch:
        a, b, s = [], [], []
        for cell in cells:
            t = pa.RecordBatch.from_struct_array(cell.values)
            t = t.take(pa.array(first_of(t.column("draw").to_numpy(), 2 * sample, t.column("fresh").to_numpy(zero_copy_only=False))))
            node, one = np.unique(t.column("node").to_numpy(), return_index=True)
            fresh = t.column("fresh").to_numpy(zero_copy_only=False)
            known = np.zeros(len(node), bool)
            np.logical_or.at(known, np.searchsorted(node, t.column("node").to_numpy()), fresh)
            vec = lifted([t.column("vec")[int(i)].as_py() for i in one])
            sims = vec @ vec.T
            np.fill_diagonal(sims, -np.inf)
            hit = (sims > t.column("worst").to_numpy()[one][:, None]) & (known[:, None] | known[None, :])
            x, y = np.nonzero(hit)
            a.append(node[x]), b.append(node[y]), s.append(sims[x, y])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        order = np.lexsort((b, -s, a))  # once each, and no more than a node can keep
        a, b, s = a[order], b[order], s[order]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        a, b, s = a[once], b[once], s[once]
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, int)
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)]))
        kept = place < degree
        return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept]), pa.array(s[kept])], ["node", "b", "sim"])

    return full.mapInArrow(join, "node long, b long, sim float")


def build_graph(vectors: DataFrame, sizes: dict[int, int], dim: int, degree: int = DEGREE, sample: int = SAMPLE,
                least_change: float = LEAST_CHANGE, seed: int = 11) -> DataFrame:
    """NN-descent over ``node, band, vec``: every round joins neighbours of neighbours and keeps each node's best ``degree``.

    Rounds go on until fewer than ``least_change`` of all neighbours are new; a node's neighbours only ever get closer, so they end.
    """
    spark, nodes = vectors.sparkSession, sum(sizes.values())
    none = F.array()
    bare = vectors.select("node", "vec", none.cast("array<long>").alias("ids"), none.cast("array<float>").alias("sims"),
                          none.cast("array<boolean>").alias("fresh"))
    count = spark.sparkContext.accumulator  # counted where rows are made: a pass of its own would cost a task a partition; a
    # task that runs again may count twice, which at worst adds a round
    graph = cut(merge_into(bare, first_neighbours(vectors, sizes, dim, degree, seed), degree, -1, sample, count(0)))
    round_, changed = 0, nodes * degree
    while changed > least_change * nodes * degree:
        new = count(0)
        graph = cut(merge_into(graph, neighbour_pairs(graph, degree, round_, sample), degree, round_, sample, new))
        release(spark)
        changed = new.value  # what is new and did not wait for its turn already
        round_ += 1
    return graph


def adjacency(graph: DataFrame, name: str, degree: int = DEGREE) -> DataFrame:
    """Each node with the ids and vectors of its neighbours and of nodes that it is a near neighbour of, so that none is out of
    reach; bucketed by node: a search step then moves queries, never the graph."""
    ahead = graph.select("node", F.posexplode("ids").alias("place", "b"))
    back = ahead.where(F.col("place") < BACK).withColumn("rank", F.row_number().over(
        Window.partitionBy("b").orderBy("place", F.xxhash64("node")))).where(F.col("rank") <= 2 * degree)
    edges = ahead.select("node", "b").unionByName(back.select(F.col("b").alias("node"), F.col("node").alias("b"))).distinct()
    rows = edges.join(graph.select(F.col("node").alias("b"), "vec"), "b").groupBy("node").agg(
        F.collect_list(F.struct("b", "vec")).alias("next")).select("node", F.col("next.b").alias("ids"), F.col("next.vec").alias("vecs"))
    spark = graph.sparkSession
    rows.write.bucketBy(shuffle_partitions(spark), "node").format("parquet").mode("errorifexists").saveAsTable(name)
    return spark.table(name)


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, expand: int = EXPAND, beam: int = BEAM) -> DataFrame:
    """Greedy graph search. ``queries``: ``qid, vec`` (a unit vector as float32, then 0 for the lift) and ``start`` (a node or null).

    Returns ``qid, ids, sims``: up to ``beam`` best nodes seen. A query holds its best candidates; each step expands the best ones not
    yet expanded, ``expand`` at once, through one join with the adjacency; a step returns only neighbours that beat the query's
    worst candidate. It ends when every query's candidates are all expanded. Similarities of all bands are on one scale. Entries
    are ``ENTRIES`` nodes of each band, one half by hash and one half the longest vectors.
    """
    spark = queries.sparkSession
    half = ENTRIES // 2
    ways = vectors.withColumns({
        "by_hash": F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("node"))),
        "by_norm": F.row_number().over(Window.partitionBy("band").orderBy("short", "node")),
    })
    entries = ways.where((F.col("by_hash") <= half) | (F.col("by_norm") <= half)).select("node", "band", "vec").collect()
    top = max(r["band"] for r in entries)

    def scale(band: np.ndarray) -> np.ndarray:
        return np.exp2(np.asarray(band, np.float64) - top).astype(np.float32)

    entry_ids, entry_vecs = np.array([r["node"] for r in entries]), lifted([bytes(r["vec"]) for r in entries])
    entry_scale = scale(np.array([r["band"] for r in entries]))
    state_type = "qid long, vec binary, ids array<long>, sims array<float>, done array<boolean>, open int"

    def pending(done: np.ndarray) -> np.ndarray:
        return np.flatnonzero(~done)[:expand]

    def out(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        left.add(sum(len(pending(r[2])) for r in rows))
        return pa.RecordBatch.from_arrays([
            batch.column("qid"), batch.column("vec"), lists([r[0] for r in rows], pa.int64()), lists([r[1] for r in rows], pa.float32()),
            pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32),
                                     pa.array(np.concatenate([*[r[2] for r in rows], np.empty(0, bool)]).astype(bool))),
            pa.array([len(pending(r[2])) for r in rows], pa.int32())], ["qid", "vec", "ids", "sims", "done", "open"])

    left = spark.sparkContext.accumulator(0)  # candidates to expand; as in build_graph, at worst it adds a step

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, start in zip(batch.column("vec").to_pylist(), batch.column("start").to_pylist()):
                sims = entry_vecs @ np.frombuffer(q, np.float32) * entry_scale
                ids = entry_ids
                if start is not None:  # always expanded first; its true similarity is at most 1
                    ids, sims = np.append(ids, start), np.append(sims, np.float32(2.0))
                a, s, f = merged(ids, -(-sims).astype(np.float32), np.zeros(len(ids), bool), beam)
                if start is not None and len(a) > 1:
                    own = a == start
                    a, s = np.r_[a[own][:1], a[~own]], np.r_[s[own].max(), s[~own]]
                rows.append((a, s, np.zeros(len(a), bool)))
            yield out(batch, rows)

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                qid, node, vec, least = [], [], [], []
                for q, v, ids, sims, done in zip(*(batch.column(c) for c in ("qid", "vec", "ids", "sims", "done"))):
                    d, s = done.values.to_numpy(zero_copy_only=False), sims.values.to_numpy()
                    at = pending(d)
                    node.append(ids.values.to_numpy()[at])
                    qid += [q.as_py()] * len(at)
                    vec += [v.as_py()] * len(at)
                    least += [float(s[-1]) if len(s) >= beam else -2.0] * len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(qid, pa.int64()), pa.array(np.concatenate(node)), pa.array(vec, pa.binary()), pa.array(least, pa.float32())],
                    ["qid", "node", "vec", "least"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                ids, sims = [], []
                for q, least, a, v in zip(part.column("vec").to_pylist(), part.column("least").to_pylist(), part.column("ids"), part.column("vecs")):
                    seen = v.values.to_pylist()
                    s = lifted(seen) @ np.frombuffer(q, np.float32) * scale(bands(seen))
                    hit = s > least
                    ids.append(a.values.to_numpy()[hit])
                    sims.append(s[hit])
                yield pa.RecordBatch.from_arrays([part.column("qid"), lists(ids, pa.int64()), lists(sims, pa.float32())], ["qid", "ids", "sims"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, sims, done, more in zip(*(batch.column(c) for c in ("ids", "sims", "done", "more"))):
                a, s, d = ids.values.to_numpy(), sims.values.to_numpy(), done.values.to_numpy(zero_copy_only=False).copy()
                d[pending(d)] = True
                if more.is_valid:
                    t = more.values
                    na, ns = t.field("ids").flatten().to_numpy(), t.field("sims").flatten().to_numpy()
                    a, s, open_ = merged(np.r_[a, na], np.r_[s, ns], np.r_[~d, np.ones(len(na), bool)], beam)
                    d = ~open_
                rows.append((a, s, d))
            yield out(batch, rows)

    name = f"nn_graph_{uuid.uuid4().hex}"
    try:
        next_ = adjacency(graph, name)
        state = cut(queries.select("qid", "vec", "start").mapInArrow(begin, state_type))
        while left.value:
            left.value = 0
            asked = state.where("open > 0").mapInArrow(frontier, "qid long, node long, vec binary, least float")
            seen = asked.join(next_, "node").select("qid", "vec", "least", "ids", "vecs").mapInArrow(
                visit, "qid long, ids array<long>, sims array<float>")
            gathered = seen.where(F.size("ids") > 0).groupBy("qid").agg(F.collect_list(F.struct("ids", "sims")).alias("more"))
            state = cut(state.join(gathered, "qid", "left").select("qid", "vec", "ids", "sims", "done", "more").mapInArrow(advance, state_type))
            release(spark)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return state.select("qid", "ids", "sims")


def nearest(
    vectors: DataFrame, wanted, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, degree: int = DEGREE,
    expand: int = EXPAND, beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products that the search finds for each row where ``wanted`` holds.

    ``wanted``: a condition on the column ``id``. Every valid vector is indexed; equal vectors are one node, and a query's own row is
    no answer to it while its copies are. Scores are doubles of the original vectors; ties go to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of
    different length are separate spaces. Rows that repeat an id are one candidate. Fewer than ``k`` candidates give fewer rows.
    """
    need(vectors, [id, vector])
    parts = []
    with small_batches(vectors.sparkSession, ROWS):  # graph and search run here; what is returned only scores their answers
        rows = pick_vectors(vectors, id, vector)
        classes, member = distinct_vectors(rows)
        member = cut(member.distinct())
        for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
            parts.append(_nearest(classes.where(F.col("dim") == dim), member, wanted, dim, k, degree, expand, beam))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest(classes, member, wanted, dim, k, degree, expand, beam) -> DataFrame:
    vectors = cut(graph_vectors(classes))
    sizes = {r["band"]: r["count"] for r in vectors.groupBy("band").count().collect()}  # a double has about 2,000 bands at most
    graph = build_graph(vectors, sizes, dim + 1, degree)

    asking = member.where(wanted).join(classes.select("digest", "rid"), "digest").select("id", "rid")
    asking = cut(asking)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f8").reshape(batch.num_rows, -1)
            x = np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(0)], ["qid", "vec", "start"])

    asked = classes.join(asking.select("rid").distinct(), "rid", "left_semi").select("rid", "unit")
    found = search(asked.mapInArrow(prepare, "qid long, vec binary, start long"), graph, vectors, expand, beam)

    # The best of them once more, in double precision on the original vectors.
    least = F.element_at("sims", F.least(F.size("sims"), F.lit(RESCORE * k + 1))) - F.lit(CLOSE)
    best = found.withColumn("least", least).select("qid", "least", F.inline(F.arrays_zip("ids", "sims"))).where(
        F.col("sims") >= F.col("least")).select("qid", F.col("ids").alias("rid"))
    raw = classes.select("rid", "raw")
    paired = best.join(raw, "rid").join(raw.select(F.col("rid").alias("qid"), F.col("raw").alias("query")), "qid")

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<f8").reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", x, y))], ["qid", "rid", "score"])

    scored = paired.select("qid", "rid", "raw", "query").mapInArrow(rescore, "qid long, rid long, score double")
    # A class answers with its k + 1 smallest ids; more of them never rank.
    few = member.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("place") <= k + 1)
    few = few.join(classes.select("digest", "rid"), "digest").select("rid", F.col("id").alias("vec_id"))
    order = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    answers = scored.join(few, "rid").withColumn("place", F.row_number().over(order("qid"))).where(F.col("place") <= k + 1).drop("place", "rid")
    each = asking.withColumnRenamed("rid", "qid").join(answers, "qid").where(F.col("id") != F.col("vec_id"))
    return each.withColumn("rank", F.row_number().over(order("id")).cast("int")).where(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", "vec_id", "score")
