"""Near-duplicate texts: similarity join of word shingles by chosen paths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need, release, small_batches
from wardline.llm.components import components, star_edges
from wardline.llm.embed_dedup import block_pairs

WORDS, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.98
#: Tokens of a text's embedding, runs made together, expected number of tokens that a node splits on.
TOKENS, RUNS, BRANCHES = 128, 8, 1.5
#: A bucket up to LIMIT texts is compared at once; deeper than DEPTH a larger one is compared block by block.
LIMIT, DEPTH, BLOCK = 200, 4, 512
#: Cells that go to Python at once: a cell of two blocks holds up to 2 * BLOCK texts' tokens or shingles.
CELLS = 16
#: Candidates: estimated similarity this far below the threshold at most (over 3.5 deviations of 128 tokens at 0.8).
SLACK = 0.125
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words of the whole text, lower case, letters, digits and ``_``.

    A text of fewer words is one run; a text without words has none.
    """
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i:len(h) - k + 1 + i]
    return np.unique(mix(out))


@lru_cache(maxsize=2)
def _factors(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, tokens, dtype=np.uint64)


def embed(items: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """``tokens`` min-hash tokens: two sets agree in as large a part of them as their Jaccard similarity, on average."""
    a, b = _factors(tokens)
    low = np.full(tokens, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        x = np.multiply.outer(items[i:i + 2048], a) + b
        np.minimum(low, x.min(axis=0), out=low)
    return mix(low)


def chosen(path: np.ndarray, tokens: int, branches: float) -> np.ndarray:
    """(paths, tokens) booleans: the token places on which each path splits, the same for all sets there; ``branches`` on average."""
    drawn = mix(path[:, None] ^ (np.arange(1, tokens + 1, dtype=np.uint64) * _ODD))
    return drawn < np.uint64(int(branches / tokens * 2 ** 64))


def child(path: np.ndarray, place: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The longer path; its last bit is still the half that the run belongs to."""
    made = mix(path ^ mix(token + (place.astype(np.uint64) + np.uint64(1)) * _ODD))
    return (made & ~np.uint64(1)) | (path & np.uint64(1))


def roots(runs: range) -> np.ndarray:
    """A path per run; even runs are one half, odd runs the other."""
    n = np.array(runs, np.uint64)
    return (mix((n + np.uint64(1)) * _ODD) & ~np.uint64(1)) | (n & np.uint64(1))


def sketches(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """``id, tie, digest binary, tokens binary``: hash of the text, digest of the whole shingle set (null: no words), its tokens'
    last 32 bits. ``id`` and ``tie`` tell the rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, digest, tokens = batch.slice(i, 256), [], []
                for t in part.column(2):
                    items = shingles(t.as_py(), words)
                    digest.append(hashlib.md5(items.tobytes()).digest() if len(items) else None)
                    tokens.append(embed(items).astype(np.uint32).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary())],
                    ["id", "tie", "digest", "tokens"])

    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text)).mapInArrow(
        run, "id long, tie long, digest binary, tokens binary")


def token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def split(rows: DataFrame, runs: range | None = None) -> DataFrame:
    """``rid, tokens`` (from the runs' roots), or ``path, rid, tokens``, one step down: ``path, rid`` for each chosen token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                rid, tokens = part.column("rid").to_numpy(), token_matrix(part.column("tokens"))
                paths = [np.full(len(rid), r) for r in roots(runs)] if runs is not None else [part.column("path").to_numpy().view(np.uint64)]
                made, of = [], []
                for path in paths:
                    one, back = np.unique(path, return_inverse=True)
                    row, place = np.nonzero(chosen(one, tokens.shape[1], BRANCHES)[back])
                    made.append(child(path[row], place, tokens[row, place].astype(np.uint64)))
                    of.append(rid[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.concatenate(of))], ["path", "rid"])

    columns = ["rid", "tokens"] if runs is not None else ["path", "rid", "tokens"]
    return rows.select(*columns).mapInArrow(run, "path long, rid long")


def alike(left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose tokens agree in ``least`` of all places or more."""
    need_, a, b = least * left.shape[1], [], []
    step = max(1, (1 << 24) // max(1, right.size))
    for i in range(0, len(left), step):
        x, y = np.nonzero((left[i:i + step, None, :] == right[None, :, :]).sum(2, dtype=np.int32) >= need_)
        a.append(x + i)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def candidates(cells: DataFrame, least: float) -> DataFrame:
    """``half, rows array<struct<rid, tokens, left, right>>`` -> star links ``half, a, b`` of pairs that look alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = pa.RecordBatch.from_struct_array(cell.values)
                rid, tokens = t.column("rid").to_numpy(), token_matrix(t.column("tokens"))
                left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
                i, j = alike(tokens[left], tokens[right], least)
                a, b = rid[left[i]], rid[right[j]]
                a, b = star_edges(a[a != b], b[a != b])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), half, np.int32)), pa.array(a), pa.array(b)], ["half", "a", "b"])

    return cells.select("half", "rows").mapInArrow(run, "half int, a long, b long")


def run_paths(classes: DataFrame, runs: range, least: float, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Star links ``half, a, b`` that ``runs`` find. ``classes``: ``rid, tokens``, distinct sets."""
    half = F.col("path").bitwiseAND(F.lit(1)).cast("int").alias("half")
    always, found = F.lit(True), None
    level = split(classes, runs)
    for d in range(1, depth + 1):
        level = cut(level)
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut(level.join(sizes, "path").join(classes, "rid"))
        small = sized.where(F.col("n") <= limit).groupBy("path").agg(F.collect_list(F.struct(
            "rid", "tokens", always.alias("left"), always.alias("right"))).alias("rows")).select(half, "rows")
        made = candidates(small, least)
        large = sized.where(F.col("n") > limit)
        if d == depth or not large.limit(1).count():
            blocks = block_pairs(large.select("path", "rid", "tokens"), BLOCK, "path", "rid").groupBy("path", "i", "j").agg(
                F.collect_list(F.struct("rid", "tokens", "left", "right")).alias("rows")).select(half, "rows")
            made = made.unionByName(candidates(blocks, least))
        with small_batches(classes.sparkSession, CELLS):
            made = cut(made.distinct())
        found = made if found is None else found.unionByName(made)
        if d == depth or not large.limit(1).count():
            return found
        level = split(large)
    return found


def recall_of(links: DataFrame) -> float:
    """Estimated share of what can be found that all runs together find, from what the two halves find apart: of texts with a
    partner, or of lone pairs (both ends know nobody else) if that is less, so large groups do not hide lone pairs.

    Each half is a sample of the other: with A and B found and AB in both, a half misses 1 - AB / A, and both miss the product.
    Where both halves find nothing at all they agree, and the estimate is 1.
    """

    def estimate(seen: DataFrame) -> float:
        n = {r["by"]: r["count"] for r in seen.groupBy("by").count().collect()}
        both, first, second = n.get(3, 0), n.get(1, 0), n.get(2, 0)
        if not both:
            return 0.0 if first + second else 1.0
        return 1.0 - first / (first + both) * second / (second + both)

    ends = links.select("half", F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("other")),
                                                  F.struct(F.col("b").alias("rid"), F.col("a").alias("other")))).alias("e")).select("half", "e.*")
    texts = cut(ends.groupBy("rid").agg(
        F.max((F.col("half") == 0).cast("int")).alias("first"), F.max((F.col("half") == 1).cast("int")).alias("second"),
        F.min("other").alias("low"), F.max("other").alias("high")).select(
        "rid", (F.col("first") + 2 * F.col("second")).alias("by"), "low", (F.col("low") == F.col("high")).alias("one")))
    single = texts.where("one")
    # One row a pair: its smaller end, where the larger end knows only that one too. The pair's halves are those of either end.
    lone = single.where("rid < low").join(single.where("rid > low").select(F.col("low").alias("rid"), F.col("rid").alias("low")), ["rid", "low"], "left_semi")
    return min(estimate(texts), estimate(lone))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exactly; memory stays bounded by slices of the common vocabulary."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], float)
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)))
    for i in range(0, len(common), 8192):
        part = common[i:i + 8192]

        def rows(sets: list[np.ndarray], part=part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[k, at[part[at] == s]] = 1.0
            return m

        out += rows(left) @ rows(right).T
    return out


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """``root, node, weight, items`` -> ``node, links, low``: exact Jaccard of all pairs of a group, block by block.

    ``links``: texts that a node links to in this block, copies counted; ``low``: a smaller node that links reach, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                t = pa.RecordBatch.from_struct_array(cell.values)
                node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
                items = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
                left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
                shared = overlaps([items[k] for k in left], [items[k] for k in right])
                size = np.array([len(x) for x in items], float)
                hit = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
                hit &= node[left][:, None] != node[right][None, :]
                i, j = np.nonzero(hit)
                links = np.zeros(len(node), np.int64)
                np.add.at(links, left, (hit @ weight[right]).astype(np.int64))
                if len(left) != len(node):
                    np.add.at(links, right, (hit.T @ weight[left]).astype(np.int64))
                low = dict(zip(*(x.tolist() for x in star_edges(node[left[i]], node[right[j]])))) if len(i) else {}
                yield pa.RecordBatch.from_arrays([
                    pa.array(node), pa.array(links), pa.array([low.get(n) for n in node.tolist()], pa.int64())], ["node", "links", "low"])

    cells = block_pairs(members, BLOCK).groupBy("root", "i", "j").agg(
        F.collect_list(F.struct("node", "weight", "items", "left", "right")).alias("rows"))
    return cells.select("rows").mapInArrow(run, "node long, links long, low long")


def similar_texts(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    target: float = TARGET_RECALL, limit: int = LIMIT, depth: int = DEPTH,
) -> DataFrame:
    """One row per document: ``id, class_id, n_links, kept``.

    Texts link from a Jaccard similarity of ``threshold`` on; classes are what links connect, named by their smallest id.
    Equal shingle sets are one row from the first shuffle on. Every run splits the sets recursively on sampled tokens that they
    share, until a bucket is small; buckets only nominate pairs, by tokens. Runs repeat until the estimated recall reaches
    ``target`` (below 1). What nominated pairs connect is then compared exactly, all pairs, in blocks, on whole texts: links are never
    counted by chance, and a large group of near copies costs blocks, not rows per pair.

    Null, empty and wordless texts, and rows with a null id (class null), link with nothing and stay. Repeated rows are copies
    of each other; different texts with one id are nodes of their own. Texts of one to four words link with their equals.
    """
    return _similar(docs, id, text, words, threshold, target, limit, depth).drop("tie")


def _similar(
    docs: DataFrame, id: str, text: str, words: int, threshold: float, target: float, limit: int, depth: int,
) -> DataFrame:
    """``similar_texts`` with ``tie``, the hash of the row's text."""
    need(docs, [id, text])
    if not 0 <= target < 1:
        raise ValueError("the target recall must be below 1")
    spark = docs.sparkSession
    sketched = cut(sketches(docs, id, text, words))
    valid = sketched.where("digest is not null and id is not null")
    # A node is a shingle set and not an id: two texts under one id may belong to different classes.
    classes = cut(valid.groupBy("digest").agg(
        F.min(F.struct("id", "tie")).alias("first"), F.count("*").alias("weight"), F.first("tokens").alias("tokens")).select(
        F.monotonically_increasing_id().alias("rid"), "digest", F.col("first.id").alias("least"), F.col("first.tie").alias("tie"),
        "weight", "tokens"))
    slim = classes.select("rid", "tokens")
    links, done = None, 0
    while True:  # every run finds each pair with a chance of its own, so the estimate rises to any target below 1
        more = run_paths(slim, range(done, done + RUNS), threshold - SLACK, limit, depth)
        links = more if links is None else cut(links.unionByName(more).distinct())
        done += RUNS
        release(spark)
        if recall_of(links) >= target:
            break
    groups = components(links.select("a", "b"))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())

    def itemize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                items = [shingles(t.as_py(), words).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(items, pa.binary())], ["root", "node", "weight", "items"])

    texts = docs.select(F.col(id).cast("long").alias("least"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    wanted = groups.join(classes.select(F.col("rid").alias("node"), "least", "tie", "weight"), "node")
    members = texts.join(wanted, ["least", "tie"]).select("root", "node", "weight", "text").mapInArrow(
        itemize, "root long, node long, weight long, items binary").dropDuplicates(["node"])
    with small_batches(spark, CELLS):
        exact = cut(verified(members, threshold))
    classes_of = components(exact.where("low is not null").select(F.col("node").alias("a"), F.col("low").alias("b")))
    counted = exact.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes_of.unionByName(classes_of.select(F.col("root").alias("node"), "root").distinct()).join(
        classes.select(F.col("rid").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("name"))
    found = classes_of.unionByName(named.select(F.col("root").alias("node"), "root")).join(named, "root").select(
        F.col("node").alias("rid"), "name")
    per_class = classes.select("digest", "rid", "least", "weight").join(found, "rid", "left").join(
        counted.withColumnRenamed("node", "rid"), "rid", "left").select(
        "digest", F.coalesce("name", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.select("id", "tie", "digest").join(per_class, "digest").select("id", "tie", "class_id", "n_links")
    alone = sketched.where("digest is null or id is null").select(
        "id", "tie", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id), "tie", "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicate(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    target: float = TARGET_RECALL, limit: int = LIMIT, depth: int = DEPTH,
) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; of rows that repeat an id and a text, one.

    Rows with a null id and different texts under one id all stay, as far as no smaller id has the same text or a near copy.
    Columns may have any names. Ids and hashes of texts travel; texts are joined once, and not at all while the removed rows are few enough to broadcast.
    """
    found = cut(_similar(docs, id, text, words, threshold, target, limit, depth))
    gone = found.where("not kept").select(F.col(id).alias("id"), "tie").distinct()
    repeated = cut(found.where("kept").groupBy(id).count().where(F.col("count") > 1).where(F.col(id).isNotNull()).select(F.col(id).alias("id")))
    # The row travels as one struct, so that none of its names meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"id": F.col("row")[id].cast("long"), "tie": F.xxhash64(F.col("row")[text])})
    rest = rows.join(gone, ["id", "tie"], "left_anti")
    if repeated.limit(1).count():
        twice = rest.join(repeated, "id", "left_semi").dropDuplicates(["id", "tie"])
        rest = rest.join(repeated, "id", "left_anti").unionByName(twice)
    return rest.select("row.*")
