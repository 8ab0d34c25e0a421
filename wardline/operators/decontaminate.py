"""Benchmark decontamination: equal texts (J1) and texts that contain a goal (J2), as anti-joins.

Nothing here compares every row with every goal. Containment goes through anchors: a fragment each
goal must share with any text that contains it. The goals' anchors are measured; as long as they fit an
executor they travel to the texts, whose hashed fragments are looked up and verified in the row, at their
place, so that no text is shuffled. Beyond that size texts emit ``(id, hash)`` pairs that meet the anchors in an
equi-join, and only the meeting pairs are verified with ``contains``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import norm_key
from wardline.plans.lineage import cut

MAX_ANCHOR_WORDS = 5
MAX_ANCHOR_CHARS = 8
PROBE_ONE_IN = 10
#: Largest goals, in characters and with 64 more a goal, that travel to the texts.
MAX_TRAVEL_CHARS = 32_000_000
#: Most ids of texts with a goal that travel to the rows they drop.
MAX_TRAVEL_IDS = 1_000_000


def distinct_keys(banned: DataFrame, text: str = "text") -> DataFrame:
    """U2. Distinct normalized benchmark texts."""
    return banned.select(norm_key(F.col(text)).alias("_key")).distinct()


def drop_equal(train: DataFrame, banned: DataFrame, text: str = "text", banned_text: str = "text") -> DataFrame:
    """J1. Rows whose normalized text is no banned text."""
    return _unequal(train, banned, text, banned_text).drop("_key")


def _unequal(train: DataFrame, banned: DataFrame, text: str = "text", banned_text: str = "text") -> DataFrame:
    """``drop_equal`` with the normalized text as ``_key``."""
    keyed = train.withColumn("_key", norm_key(F.col(text)))
    return keyed.join(distinct_keys(banned, banned_text), "_key", "left_anti")


def goal_keys(goals: DataFrame, text: str = "text") -> DataFrame:
    """Distinct non-empty normalized goals with the shape of their anchor.

    First and last word of a goal may end inside longer words of a text, its interior words may not;
    so a goal of three or more words is anchored on up to five interior words (``size`` counts them,
    ``kind`` = word), a shorter one on its first characters (``kind`` = char).
    """
    keys = goals.select(norm_key(F.col(text)).alias("goal")).where(F.length("goal") > 0).distinct()
    words = F.size(F.split("goal", " "))
    return keys.withColumn("kind", F.when(words >= 3, "word").otherwise("char")).withColumn(
        "size",
        F.when(F.col("kind") == "word", F.least(words - 2, F.lit(MAX_ANCHOR_WORDS)))
        .otherwise(F.least(F.char_length("goal"), F.lit(MAX_ANCHOR_CHARS))),
    )


def _positions(first: int, last: Column) -> Column:
    """``first .. last``, empty when ``last`` comes before ``first``."""
    return F.filter(F.sequence(F.lit(first), F.greatest(last, F.lit(first))), lambda i: i <= last)


def _word_hashes(words: Column, size: int, first: int, last: Column) -> Column:
    """Hashes of the runs of ``size`` words that start at positions ``first .. last``."""
    return F.transform(
        _positions(first, last),
        lambda i: F.xxhash64(F.lit("word"), F.lit(size), *[F.get(words, i + (k - 1)) for k in range(size)]),
    )


def _char_hashes(text: Column, size: int, last: Column) -> Column:
    return F.transform(
        _positions(1, last), lambda i: F.xxhash64(F.lit("char"), F.lit(size), F.substr(text, i, F.lit(size)))
    )


def _fragments(text: Column, shapes: list[tuple[str, int]]) -> Column:
    """Distinct hashed fragments of every wanted shape."""
    def hashed(words: Column) -> Column:
        parts = [
            _word_hashes(words, size, 1, F.size(words) - (size - 1)) if kind == "word"
            else _char_hashes(text, size, F.char_length(text) - (size - 1))
            for kind, size in shapes
        ]
        return F.array_distinct(F.concat(*parts))

    # The one-element array binds the word list, so that it is split once.
    return F.transform(F.array(F.split(text, " ")), hashed)[0]


def _anchor_choices(keys: DataFrame, shapes: list[tuple[str, int]]) -> DataFrame:
    """Every fragment that could anchor each goal, as ``goal, anchor, place``: words of the goal before it, of equal ones the
    first, and 0 for characters."""
    options = []
    for kind, size in shapes:
        of_shape = keys.where((F.col("kind") == kind) & (F.col("size") == size))
        if kind == "word":
            words = F.split("goal", " ")
            interior = _word_hashes(words, size, 2, F.size(words) - size)
        else:
            interior = _char_hashes(F.col("goal"), size, F.lit(1))
        options.append(of_shape.select("goal", F.posexplode(interior).alias("at", "anchor")).groupBy("goal", "anchor").agg(
            (F.min("at") + (1 if kind == "word" else 0)).alias("place")))
    stacked = options[0]
    for more in options[1:]:
        stacked = stacked.unionByName(more)
    return stacked


def _hashes(texts: DataFrame, shapes: list[tuple[str, int]]) -> DataFrame:
    return texts.select("_id", F.explode(_fragments(F.col("_norm"), shapes)).alias("anchor"))


def _placed(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Hashed runs of words, as ``_id, _words, _at, anchor``, one row for each of ``sizes`` and each place ``_at`` that has a word
    before and one after the run: interior words of a goal have both. All of it is generated code over one list of words."""
    words = texts.select("_id", F.split("_norm", " ").alias("_words"))
    last = F.size("_words") - (min(sizes) + 1)
    # No lambda: an operator that holds one is not compiled.
    at = words.select("_id", "_words", F.explode_outer(F.when(last >= 1, F.sequence(F.lit(1), last))).alias("_at"))
    runs = [F.xxhash64(F.lit("word"), F.lit(n), *[F.get("_words", F.col("_at") + k) for k in range(n)]) for n in sizes]
    return at.select("_id", "_words", "_at", runs[0].alias("anchor") if len(runs) == 1 else F.explode(F.array(*runs)).alias("anchor"))


def _anchors(texts: DataFrame, keys: DataFrame, shapes: list[tuple[str, int]]) -> DataFrame:
    """``goal, anchor, place``: each goal with the fragment of it that is rarest in a tenth of the texts."""
    choices = _anchor_choices(keys, shapes)
    # The tenth is chosen by id, so that only its texts are normalized.
    probe = texts.where(F.pmod(F.xxhash64("_id"), F.lit(PROBE_ONE_IN)) == 0)
    words, chars = [n for kind, n in shapes if kind == "word"], [x for x in shapes if x[0] == "char"]
    seen = ([_placed(probe, words).select("_id", "anchor")] if words else []) + ([_hashes(probe, chars)] if chars else [])
    frequency = (
        reduce(DataFrame.unionByName, seen)
        .join(choices.select("anchor").distinct(), "anchor")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("_df"))
    )
    return (
        choices.join(frequency, "anchor", "left")
        .groupBy("goal")
        .agg(F.min(F.struct(F.coalesce(F.col("_df"), F.lit(0)).alias("df"), F.col("anchor"), F.col("place"))).alias("_best"))
        .select("goal", F.col("_best.anchor").alias("anchor"), F.col("_best.place").alias("place"))
    )


def containing(
    train: DataFrame, goals: DataFrame, id_: str, text: str = "text", goal_text: str = "text", max_travel: int = MAX_TRAVEL_CHARS
) -> DataFrame:
    """``id, goal`` pairs where the normalized text contains the normalized goal (exact).

    ``id_`` must identify a row. The goal shapes in use (at most 13) and the goals' size are read first.
    Each goal is anchored on its rarest fragment, so boilerplate shared by many texts makes no candidates
    as long as the goal holds anything rarer. Goals of more than ``max_travel`` characters are joined.
    """
    # Never null, and exploded as outer rows: else Spark infers filters that normalize every text once more below.
    texts = train.select(F.col(id_).alias("_id"), F.coalesce(norm_key(F.col(text)), F.lit("")).alias("_norm"))
    return _containing(texts, goals, goal_text, max_travel).withColumnRenamed("_id", id_)


def _containing(texts: DataFrame, goals: DataFrame, goal_text: str, max_travel: int = MAX_TRAVEL_CHARS) -> DataFrame:
    """``containing`` for texts that are normalized already: ``_id, _norm`` to ``_id, goal``."""
    keys = goal_keys(goals, goal_text)
    measured = keys.groupBy("kind", "size").agg(F.sum(F.char_length("goal") + 64).alias("chars")).collect()
    shapes = sorted((r["kind"], r["size"]) for r in measured)
    if not shapes:
        return texts.select("_id", F.lit(None).cast("string").alias("goal")).where(F.lit(False))
    anchors = _anchors(texts, keys, shapes)
    if sum(r["chars"] for r in measured) > max_travel:
        met = texts.join(_hashes(texts, shapes).join(anchors, "anchor").select("_id", "goal"), "_id")
        return met.where(F.contains("_norm", F.col("goal"))).select("_id", "goal")
    words, chars = [n for kind, n in shapes if kind == "word"], [x for x in shapes if x[0] == "char"]
    found = []
    if words:
        # Only the words about the run are compared: as many as the goal has, so the goal's spaces can fall on theirs alone.
        count, begin = F.size(F.split("goal", " ")), F.col("_at") - F.col("place") + 1
        about = F.array_join(F.slice("_words", F.greatest(begin, F.lit(1)), count), " ")
        met = _placed(texts, words).join(F.broadcast(anchors), "anchor")
        # Once a row, wherever else in it the goal stands: where no window before this one holds it.
        before = F.array_join(F.slice("_words", F.lit(1), F.greatest(begin + count - 2, F.lit(0))), " ")
        first = (begin >= 1) & F.contains(about, F.col("goal")) & ~F.contains(before, F.col("goal"))
        found.append(met.where(first).select("_id", "goal"))
    if chars:
        # Fragments are hashed below the explode, which then is generated code and copies no text a fragment.
        hashed = texts.withColumn("_hashes", _fragments(F.col("_norm"), chars))
        met = hashed.select("_id", "_norm", F.explode_outer("_hashes").alias("anchor")).join(F.broadcast(anchors), "anchor")
        found.append(met.where(F.contains("_norm", F.col("goal"))).select("_id", "goal"))
    return reduce(DataFrame.unionByName, found)


def drop_containing(
    train: DataFrame, goals: DataFrame, id_: str, text: str = "text", goal_text: str = "text"
) -> DataFrame:
    """J2. Rows that contain no goal. The ids of the others are found first: up to ``MAX_TRAVEL_IDS`` travel to the rows,
    more are joined."""
    return _without(train, containing(train, goals, id_, text, goal_text), id_)


def _without(train: DataFrame, met: DataFrame, id_: str) -> DataFrame:
    hit = cut(met.select(id_).distinct())
    return train.join(F.broadcast(hit) if hit.count() <= MAX_TRAVEL_IDS else hit, id_, "left_anti")


def decontaminate(
    train: DataFrame, banned: DataFrame, goals: DataFrame, id_: str, text: str = "text"
) -> DataFrame:
    """J1 then J2 (U3): training rows that neither equal a banned text nor contain a goal."""
    left = _unequal(train, banned, text)
    texts = left.select(F.col(id_).alias("_id"), F.coalesce("_key", F.lit("")).alias("_norm"))  # normalized once for both
    return _without(left.drop("_key"), _containing(texts, goals, "text").withColumnRenamed("_id", id_), id_)


def dropped_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """A28. One row: rows before, after and dropped."""
    sizes = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return sizes.agg(
        F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), (F.sum("b") - F.sum("a")).alias("n_dropped")
    )
