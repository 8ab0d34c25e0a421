"""Toxic text by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need

FEATURES = 1 << 18
GRAMS = (4, 5)
#: Training rows: about so many confirmed toxic and so many unlabelled texts at most, those with the smallest hashes.
#: A text is at most FEATURES numbers, so the sample has a bound whatever the corpus; every text is scored.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12_000
LEAST_LIFT = 1.5
FOLDS, MODELS, EPOCHS, BATCH, RATE, DECAY = 5, 3, 12, 512, 0.03, 1e-4
#: Words that a worker remembers, and the longest one that it does.
REMEMBERED, LONG = 200_000, 64
_WORD = re.compile(r"\w+")


class Encoder:
    """Whole text -> sorted distinct feature numbers: its words and their character 4- and 5-grams, hashed."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        runs = (marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1))
        number = lambda g: zlib.crc32(g.encode("utf-8", "replace")) % FEATURES
        if len(word) > LONG:  # seldom recurs and would fill the memory
            return np.unique(np.fromiter(map(number, chain([marked], runs)), np.int32))
        made = np.array([number(g) for g in {marked, *runs}], np.int32)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[word] = made
        return made

    def __call__(self, text: str | None) -> np.ndarray:
        get = self.known.get
        parts = []
        for w in set(_WORD.findall((text or "").lower())):
            x = get(w)
            parts.append(self.word(w) if x is None else x)
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


@lru_cache(maxsize=1)
def encoder() -> Encoder:
    """One memory for all tasks of a worker."""
    return Encoder()


def lifts(toxic: np.ndarray, every: np.ndarray, n_toxic: int, n_every: int, prior: float) -> np.ndarray:
    """Log lift of each feature in toxic texts over clean ones, shrunk to 0 where little is known; 0 below ``LEAST_LIFT``.

    ``toxic`` and ``every``: texts with the feature among the confirmed and the unlabelled ones. The share of clean texts is what
    the unlabelled share leaves once the toxic part is taken off, never below zero: the same correction that the risk makes.
    """
    clean = np.maximum(0.0, every / max(1, n_every) - prior * toxic / max(1, n_toxic)) / (1 - prior)
    r = np.log((toxic + 2.0) / (clean * n_toxic + 2.0))
    return np.where(np.abs(r) >= LEAST_LIFT, r, 0.0)


def sums(rows: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's features."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ends = np.concatenate([[0.0], np.cumsum(values[np.concatenate([*rows, np.empty(0, np.int32)])])])
    return ends[at[1:]] - ends[at[:-1]]


def logits(rows: list[np.ndarray], model: np.ndarray) -> np.ndarray:
    """``model``: one row of summed weights (weight times lift), one of squared lifts; the last column is the intercept."""
    return sums(rows, model[0]) / np.sqrt(1.0 + sums(rows, model[1])) + model[0, -1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def set_threshold(model: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Move the intercept so that 0.5 has the least error as positive and unlabelled texts estimate it.

    prior * misses + max(0, share of unlabelled above - prior * hits): the same class-prior-corrected, non-negative risk,
    with 0-1 loss. Where it is flat its middle is taken.
    """
    zp, zu = np.sort(logits(positive, model)), np.sort(logits(unlabelled, model))
    at = np.unique(np.concatenate([zp, zu]))
    at = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]])
    hit = 1 - np.searchsorted(zp, at) / len(zp)
    risk = prior * (1 - hit) + np.maximum(0, 1 - np.searchsorted(zu, at) / len(zu) - prior * hit)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    model = model.copy()
    model[0, -1] -= (at[best[0]] + at[best[-1]]) / 2
    return model


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], lift: np.ndarray, prior: float, seed: int = 0,
          epochs: int = EPOCHS) -> np.ndarray:
    """Minimise the non-negative PU risk (Kiryo et al., 2017) with the logistic loss over lift-weighted, unit-length features.

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): the unlabelled texts stand for negatives once the share of positives
    among them is taken off. When a batch drives the second term below zero, the step goes up its slope instead, which
    keeps the model from learning the unlabelled positives by heart.
    """
    rng = np.random.default_rng(seed)
    kept = np.flatnonzero(lift)
    place = np.full(FEATURES, -1)
    place[kept] = np.arange(len(kept))
    value = lift[kept]

    def slim(rows):
        small = [place[r] for r in rows]
        small = [r[r >= 0] for r in small]
        return small, 1.0 / np.sqrt(1.0 + sums(small, value ** 2))

    (pos, norm_p), (unl, norm_u) = slim(positive), slim(unlabelled)
    w, m, v = (np.zeros(len(kept) + 1) for _ in range(3))
    w[:-1], w[-1] = 1.0, np.log(prior / (1 - prior))
    steps, size_p = 0, max(8, BATCH // 3)
    for epoch in range(epochs):
        order = rng.permutation(len(unl))
        rate = RATE * (1 - epoch / epochs) + 1e-4
        for i in range(0, len(order), BATCH):
            at_u, at_p = order[i:i + BATCH], rng.integers(0, len(pos), size_p)
            u, p = [unl[k] for k in at_u], [pos[k] for k in at_p]
            weighed = w[:-1] * value
            zp, zu = sums(p, weighed) * norm_p[at_p] + w[-1], sums(u, weighed) * norm_u[at_u] + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp = -prior / len(p) * np.ones(len(p))
                gu = sigmoid(zu) / len(u)
            else:
                gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
            rows, slope = p + u, np.concatenate([gp, gu])
            spread = np.repeat(slope * np.concatenate([norm_p[at_p], norm_u[at_u]]), [len(r) for r in rows])
            g = np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]), spread, len(kept) + 1)
            g[:-1] = g[:-1] * value + DECAY * (w[:-1] - 1.0)
            g[-1] = slope.sum()
            steps += 1
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.99 ** steps)) + 1e-8)
    model = np.zeros((2, FEATURES + 1))
    model[0, kept], model[0, -1] = w[:-1] * value, w[-1]
    model[1, kept] = value ** 2
    return model


def fit(rows: list[tuple[bool, int, np.ndarray]], counts: np.ndarray, sizes: np.ndarray, prior: float, models: int = MODELS) -> list[np.ndarray]:
    """Models that each keep another fold of the texts for their threshold. ``rows``: (confirmed, fold, features);
    ``counts``: (confirmed, fold, feature) texts; ``sizes``: (confirmed, fold) texts."""
    made = []
    for k in range(models):
        pick = lambda flag, own: [r for y, fold, r in rows if y == flag and (fold == k) == own]  # noqa: B023, E731
        others = np.arange(FOLDS) != k
        use = others if sizes[1, others].sum() and sizes[0, others].sum() else np.ones(FOLDS, bool)
        lift = lifts(counts[1, use].sum(0), counts[0, use].sum(0), int(sizes[1, use].sum()), int(sizes[0, use].sum()), prior)
        every = [[r for y, _, r in rows if y == flag] for flag in (True, False)]
        model = train(pick(True, False) or every[0], pick(False, False) or every[1], lift, prior, seed=k)
        made.append(set_threshold(model, pick(True, True) or every[0], pick(False, True) or every[1], prior).astype(np.float32))
    return made


def held_out(id: Column) -> Column:
    """A fifth of the ids, by CRC-32 of their text."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(False))


def fraction(id: Column, *more: Column) -> Column:
    """Uniform in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.lit("sample"), id, *more), F.lit(1 << 40)) / F.lit(float(1 << 40))


def learn(docs: DataFrame, labels: DataFrame, id: str, text: str, max_positive: int, max_unlabelled: int) -> list[np.ndarray] | None:
    """Models from the rows that are not held out; None without a confirmed toxic text.

    The prior is the toxic share of the labelled rows. Samples are taken by hash at rates known before any text is read.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(~held_out(F.col("doc_id")))
    total = docs.count()
    if not toxic or not total:
        return None
    prior = min(0.9, max(1e-3, toxic / n))
    picked = known.where((F.col("toxic") == 1) & (fraction(F.col("doc_id")) < max_positive / toxic)).select("doc_id")
    positives = rows.join(F.broadcast(picked), "doc_id", "left_semi")  # about max_positive ids at most
    others = rows.where(fraction(F.col("doc_id"), F.col("text")) < max_unlabelled / total)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [encode_text(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([zlib.crc32(r.tobytes()) % FOLDS for r in rows], pa.int32()),
                    pa.array([r.tobytes() for r in rows], pa.binary())], ["positive", "fold", "row"])

    sample = cut(positives.select(F.lit(True).alias("positive"), "text").unionByName(
        others.select(F.lit(False).alias("positive"), "text")).mapInArrow(encode, "positive boolean, fold int, row binary"))
    sizes = np.zeros((2, FOLDS), np.int64)
    for r in sample.groupBy("positive", "fold").count().collect():
        sizes[int(r["positive"]), r["fold"]] = r["count"]
    if not sizes.sum(1).all():
        return None
    cells = [f"c{i}" for i in range(2 * FOLDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2 * FOLDS, FEATURES), np.int32)
        for batch in batches:
            for flag, fold, row in zip(*(c.to_pylist() for c in batch.columns)):
                n[FOLDS * flag + fold, np.frombuffer(row, np.int32)] += 1
        seen = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(x[seen]) for x in n)], ["feature", *cells])

    # The driver gets one row per feature, then only the features that tell toxic from clean: never a text's whole row.
    told = sample.mapInArrow(count, "feature int, " + ", ".join(f"{c} int" for c in cells)).groupBy("feature").agg(
        *[F.sum(c).cast("int").alias(c) for c in cells]).toArrow()
    counts = np.zeros((2 * FOLDS, FEATURES), np.int32)
    at = told.column("feature").to_numpy()
    for i, c in enumerate(cells):
        counts[i, at] = told.column(c).to_numpy()
    counts = counts.reshape(2, FOLDS, FEATURES)
    telling = np.zeros(FEATURES, bool)
    for k in (*range(MODELS), FOLDS):
        use = np.arange(FOLDS) != k
        telling |= lifts(counts[1, use].sum(0), counts[0, use].sum(0), int(sizes[1, use].sum()), int(sizes[0, use].sum()), prior) != 0

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(r, np.int32) for r in batch.column("row").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[telling[r]].tobytes() for r in rows], pa.binary())], ["positive", "fold", "row"])

    table = sample.mapInArrow(slim, "positive boolean, fold int, row binary").toArrow()
    rows = [(y, fold, np.frombuffer(r, np.int32)) for y, fold, r in zip(*(c.to_pylist() for c in table.columns))]
    rows.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2].tobytes()), len(r[2])))  # tasks return in any order
    return fit(rows, counts, sizes, prior)


def score(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> DataFrame:
    """All columns of ``docs`` and ``tox_score`` (0 to 1), ``tox_predicted`` (1 from 0.5 on).

    ``labels``: ``doc_id, toxic``; only toxic = 1 of rows that are not held out teaches what toxic is, the other texts are
    unlabelled. A score is a function of the text alone. Null and empty texts get the score of no features; without any
    confirmed toxic text all scores are 0. Rows with null or repeated ids are scored like others. Nothing is shuffled.
    """
    need(docs, [id, text])
    need(labels, ["doc_id", "toxic"])
    keep = [c for c in docs.columns if c not in ("tox_score", "tox_predicted")]
    models = learn(docs, labels, id, text, max_positive, max_unlabelled)
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    if models is None:
        return source.withColumns({"tox_score": F.lit(0.0), "tox_predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(models)  # 2 MB a model
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text, weights = encoder(), [m.astype(float) for m in shared.value]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [encode_text(t) for t in part.column(at).to_pylist()]
                value = np.mean([sigmoid(logits(rows, w)) for w in weights], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, "tox_score", "tox_predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    plain = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # mapInArrow reads a dot in a name as a path
    return plain.mapInArrow(run, f"{fields}{', ' if fields else ''}tox_score double, tox_predicted int")
