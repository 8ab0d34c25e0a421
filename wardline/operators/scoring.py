"""Linear heads over TF-IDF blocks (J4, A4, T10), and pluggable scorers (V1).

A model is one wide table ``kind, term, idf, <head>..`` plus an intercept per head. Its rows are bounded
by the vocabulary caps, which ``checked_model`` verifies before the table is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import logistic, segments
from wardline.operators.features import ANCHOR_KIND, CHAR_TERMS, WORD_TERMS, apart, term_counts
from wardline.operators.linear_scorer import load_linear, with_linear_scores
from wardline.settings import HEADS

MAX_MODEL_TERMS = 4 * (WORD_TERMS + CHAR_TERMS)


def wide_model(vocab: DataFrame, weights: DataFrame, heads: Sequence[str] = HEADS) -> DataFrame:
    """Vocabulary and long weights ``head, kind, term, weight`` as one wide row per term."""
    per_term = weights.groupBy("kind", "term").agg(
        *[F.sum(F.when(F.col("head") == h, F.col("weight")).otherwise(0.0)).alias(h) for h in heads]
    )
    return vocab.select("kind", "term", "idf").join(per_term, ["kind", "term"], "left").select(
        "kind", "term", "idf", *[F.coalesce(F.col(h), F.lit(0.0)).alias(h) for h in heads]
    )


def checked_model(model: DataFrame, limit: int = MAX_MODEL_TERMS) -> DataFrame:
    """Broadcast hint behind a row count; an oversized model is joined by shuffle instead."""
    return F.broadcast(model) if model.limit(limit + 1).count() <= limit else model


def _with_anchor(model: DataFrame, heads: Sequence[str]) -> DataFrame:
    spark = model.sparkSession
    anchor = spark.range(1).select(
        F.lit(ANCHOR_KIND).alias("kind"), F.lit("").alias("term"), F.lit(0.0).alias("idf"),
        *[F.lit(0.0).alias(h) for h in heads],
    )
    return model.select("kind", "term", "idf", *heads).unionAll(anchor)


def linear_scores(
    df: DataFrame,
    id_: str,
    model: DataFrame,
    intercepts: Mapping[str, float],
    text: str = "text",
    per_sentence: bool = True,
    engine: str = "jvm",
) -> DataFrame:
    """A4, J4, L6. ``id, <head>..``: per-head maximum over the whole text and, if asked, its sentences; no row for a null text.

    A model within the cap travels to the texts; texts that share their id, and all texts under a larger model, are joined.
    """
    if model.limit(MAX_MODEL_TERMS + 1).count() > MAX_MODEL_TERMS:
        return joined_scores(df, id_, model, intercepts, text, per_sentence, engine)
    alone, again = apart(df.select(id_, text), id_)
    here = with_linear_scores(
        alone.where(F.col(text).isNotNull()), load_linear(model, intercepts), text, per_sentence, engine
    ).select(id_, *intercepts)
    return here if again is None else here.unionAll(joined_scores(again, id_, model, intercepts, text, per_sentence, engine))


def joined_scores(
    df: DataFrame,
    id_: str,
    model: DataFrame,
    intercepts: Mapping[str, float],
    text: str = "text",
    per_sentence: bool = True,
    engine: str = "jvm",
) -> DataFrame:
    """``linear_scores`` for models of any size and ids that repeat: the texts of one id count together.

    One exchange: texts are placed by ``id_`` and term counts, block norms, dot products and the final
    maximum all happen where the text lies.
    """
    heads = list(intercepts)
    parts = segments(F.col(text)) if per_sentence else F.array(F.col(text))
    pieces = df.select(F.col(id_).alias("_id"), F.posexplode(parts).alias("_seg", "_text"))
    counts = term_counts(pieces, ["_id", "_seg"], "_text", engine)
    known = counts.join(checked_model(_with_anchor(model, heads)), ["kind", "term"]).withColumn(
        "_v", (F.ln("tf") + 1.0) * F.col("idf")
    )
    blocks = known.groupBy("_id", "_seg", "kind").agg(
        F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"),
        *[F.sum(F.col("_v") * F.col(h)).alias(h) for h in heads],
    )
    logits = blocks.groupBy("_id", "_seg").agg(
        *[F.sum(F.when(F.col("_norm") > 0, F.col(h) / F.col("_norm")).otherwise(0.0)).alias(h) for h in heads]
    )
    best = logits.groupBy("_id").agg(*[F.max(h).alias(h) for h in heads])
    # The link is monotone, so the largest logit gives the largest probability.
    return best.select(
        F.col("_id").alias(id_), *[logistic(F.col(h) + F.lit(float(b))).alias(h) for h, b in intercepts.items()]
    )


def heads_map(heads: Sequence[str] = HEADS) -> Column:
    """Per-head columns as the map the guard reads."""
    return F.create_map(*[x for h in heads for x in (F.lit(h), F.col(h))])


def with_scores(df: DataFrame, scores: DataFrame, id_: str, heads: Sequence[str] = HEADS, out: str = "heads") -> DataFrame:
    """J5. Attach scores to rows by id; a row without scores keeps a null map."""
    return df.join(scores.select(id_, heads_map(heads).alias(out)), id_, "left")


# -- pluggable scorers -------------------------------------------------------------------------------
BatchScorer = Callable[[pd.Series], pd.DataFrame]
_SCORERS: dict[str, tuple[Callable[[], BatchScorer], tuple[str, ...]]] = {}


def register_scorer(name: str, load: Callable[[], BatchScorer], heads: Sequence[str] = HEADS) -> None:
    """V1. ``load()`` runs once per task and returns ``texts -> DataFrame`` with one column per head."""
    _SCORERS[name] = (load, tuple(heads))


def score_with(df: DataFrame, scorer: str, text: str = "text", out: str = "heads") -> DataFrame:
    """V1. Add a ``map(head -> probability)`` column from a registered scorer, Arrow batch by batch.

    Only the text travels to Python. Texts of a batch are scored in order of length, so a scorer
    that pads its batch wastes little.
    """
    load, heads = _SCORERS[scorer]
    schema = T.StructType([T.StructField(h, T.DoubleType()) for h in heads])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for texts in batches:
            by_length = texts.fillna("").str.len().sort_values(kind="stable").index
            scored = score(texts.fillna("").loc[by_length])
            scored.index = by_length
            yield scored.loc[texts.index, list(heads)].astype("float64")

    scored = df.withColumn("_scored", run(F.col(text)))
    pairs = [x for h in heads for x in (F.lit(h), F.col("_scored")[h])]
    return scored.withColumn(out, F.create_map(*pairs)).drop("_scored")
