"""Conversation monitor as a batch job.

All windows of a conversation share one exchange and one sort; every frame is bounded, so long conversations are cut into
blocks, see ``blocks``. The ledger reads every earlier turn: it is folded block by block from a carried start, see ``carries``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.functions.numbers import rounded
from wardline.operators import blocks
from wardline.operators.blocks import BLOCK, DEFAULT_BLOCK_ROWS, HOT, OWN
from wardline.settings import ConversationSettings

WindowScorer = Callable[[DataFrame], DataFrame]


def _frame(keys: Sequence[str], order: str, back: int, upto: int = 0) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(-back, upto)


def window_text(keys: Sequence[str], order: str, text: str, masked: str, settings: ConversationSettings) -> Column:
    """W2. Earlier masked turns plus the raw current one, last ``window_max_chars`` characters; null for a first turn."""
    back = settings.window_turns - 1
    if back == 0:
        return F.lit(None).cast("string")
    earlier = F.collect_list(masked).over(_frame(keys, order, back, -1))
    joined = F.concat(F.array_join(earlier, "\n"), F.lit("\n"), F.col(text))
    return F.when(F.size(earlier) > 0, F.right(joined, F.lit(settings.window_max_chars)))


def carries(placed: DataFrame, keys: Sequence[str], order: str, risk: str, settings: ConversationSettings) -> DataFrame:
    """``_key0 .., _of, _start``: the ledger before each block of a long conversation.

    A block of n turns takes the ledger from x to ``alpha ** n * x + b``, where b is its own fold from zero. These maps, one
    a block, are composed along the conversation. A block that is longer than ``settings.memory_rows`` forgets its start to the
    last bit, so its b is the very number that one long fold arrives at.
    """
    others = [f"_key{i}" for i in range(len(keys))]
    alpha, beta = settings.alpha, settings.beta
    rows = placed.where(F.col(HOT) & F.col(OWN)).select(
        *[F.col(k).alias(o) for k, o in zip(keys, others)], F.col(BLOCK).alias("_of"), F.col(order).alias("_order"),
        F.coalesce(F.col(risk), F.lit(0.0)).alias("_risk"),
    )
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*others, "_of").orderBy("_order")))
    named = [*others, "_of"]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, folded = None, 0, 0.0

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(last.column(c) for c in named), pa.array([alpha ** n]), pa.array([folded])], [*named, "_rate", "_added"])

        for batch in batches:
            for i, (row, r) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("_risk").to_pylist())):
                if row == 1:
                    if last is not None:
                        yield ended()
                    n, folded = 0, 0.0
                last = batch.slice(i, 1)
                n, folded = n + 1, alpha * folded + beta * r
        if last is not None:
            yield ended()

    schema = numbered.select(*named).schema.add("_rate", "double").add("_added", "double")
    slim = numbered.sortWithinPartitions(*named, "_order").select(*named, "_row", "_risk")
    steps = F.array_sort(F.collect_list(F.struct("_of", "_rate", "_added")))
    per_key = slim.mapInArrow(maps, schema).groupBy(*others).agg(steps.alias("_steps"))
    starts = F.aggregate(
        F.col("_steps"), F.array(F.lit(0.0)),
        lambda made, s: F.concat(made, F.array(s["_rate"] * F.element_at(made, -1) + s["_added"])),
    )
    return per_key.select(*others, F.inline(F.transform(
        F.arrays_zip(F.col("_steps"), F.slice(starts, 1, F.size("_steps")).alias("_starts")),
        lambda x: F.struct(x["_steps"]["_of"].alias("_of"), x["_starts"].alias("_start")),
    )))


def folded(signals: DataFrame, keys: Sequence[str], order: str, settings: ConversationSettings) -> DataFrame:
    """Add ``ledger`` (W3), ``flagged`` and the block's ``first_flagged_turn`` so far.

    ``signals`` hold ``_row`` (1 at the first row of a block), ``_start``, ``risk``, ``window_hit`` and ``n``, and are co-located by
    block, as the windows before leave them. One pass in order, each row read once; copies are passed over.
    """
    alpha, beta, limit = settings.alpha, settings.beta, settings.flag_threshold
    source = signals.sortWithinPartitions(*keys, BLOCK, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, first = 0.0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_row", "_start", OWN, "risk", "window_hit", "n")]
            values, flags, firsts = [], [], []
            for row, start, own, risk, hit, n in zip(*columns):
                if row == 1:
                    value, first = start, None
                if own:
                    value = alpha * value + beta * (risk or 0.0)
                flagged = own and (bool(hit) or value >= limit)
                if flagged and first is None:
                    first = n
                values.append(value)
                flags.append(flagged)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64()), pa.array(flags, pa.bool_()), pa.array(firsts, pa.int64())],
                [*batch.schema.names, "ledger", "flagged", "first_flagged_turn"])

    schema = StructType([*source.schema.fields]).add("ledger", "double").add("flagged", "boolean").add("first_flagged_turn", "long")
    return source.mapInArrow(run, schema)


def placed_turns(
    turns: DataFrame,
    keys: Sequence[str],
    order: str,
    settings: ConversationSettings,
    block_rows: int | None = None,
) -> DataFrame:
    """User turns in blocks, numbered from 1 as ``n`` (W1). Blocks are long enough for the ledger to forget, if not given."""
    rows = block_rows or max(DEFAULT_BLOCK_ROWS, 2 * settings.memory_rows)
    placed = blocks.place(turns, keys, order, settings.lookback_rows, rows)
    return placed.withColumn("n", blocks.position(keys, order))


def with_window_text(
    placed: DataFrame, keys: Sequence[str], order: str, text: str, masked: str, settings: ConversationSettings
) -> DataFrame:
    """W2 on placed turns."""
    return placed.withColumn("window_text", window_text(keys, order, text, masked, settings))


def _hits(scored: DataFrame, keys: Sequence[str], order: str, settings: ConversationSettings) -> DataFrame:
    """Placed turns with ``_row`` and ``window_hit``, and the ledger's ``_start`` of their block."""
    in_window = _frame(keys, order, settings.window_turns - 1)
    hits = scored.withColumns({
        "_row": F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(order)),
        "window_hit": (F.count(F.lit(1)).over(in_window) > 1)
        & (F.col("window_score") >= settings.threshold)
        & (F.max("risk").over(in_window) < settings.threshold),
    })
    starts = carries(scored, keys, order, "risk", settings)
    others = [f"_key{i}" for i in range(len(keys))]
    same = blocks.same_keys(hits, starts, keys, others) & (hits[BLOCK] == starts["_of"])
    # One row a block of a long conversation: one in memory_rows turns at most.
    begun = hits.join(F.broadcast(starts), same, "left").withColumn("_start", F.coalesce("_start", F.lit(0.0)))
    return begun.drop("_of", *others)


def with_flags(scored: DataFrame, keys: Sequence[str], order: str, settings: ConversationSettings) -> DataFrame:
    """W3-W8 on placed turns that carry ``n, risk, head, window_score, window_head``."""
    in_window = _frame(keys, order, settings.window_turns - 1)
    kept = _frame(keys, order, settings.turns_kept - 1)
    shown = _frame(keys, order, settings.history_shown - 1)
    signals = scored.withColumns({
        "_top_head": F.max_by("head", F.struct(F.col("risk"), -F.col("n"))).over(in_window),
        "_first_risky": F.min(F.when(F.col("risk") >= settings.risky_turn, F.col("n"))).over(kept),
        "history": F.collect_list(
            F.struct(F.col("n").alias("turn"), rounded(F.col("risk"), 4).alias("risk"))
        ).over(shown),
    })
    done = folded(_hits(signals, keys, order, settings), keys, order, settings)
    # First flags of the earlier blocks of long conversations: the others never enter this branch.
    slim = scored.where(HOT).select(*keys, order, "risk", "n", "window_score", BLOCK, OWN, HOT)
    early = folded(_hits(slim, keys, order, settings), keys, order, settings).where(OWN)
    sticky = blocks.with_earlier_min(done, early, keys, F.when(F.col("flagged"), F.col("n")), "first_flagged_turn")
    return sticky.withColumn("ledger_hit", F.col("ledger") >= settings.flag_threshold)


def _reason(settings: ConversationSettings) -> Column:
    window_start = F.greatest(F.col("n") - (settings.window_turns - 1), F.lit(1))
    return F.when(
        F.col("window_hit"),
        F.format_string("window: '%s' payload split across turns %d-%d", F.col("window_head"), window_start, F.col("n")),
    ).when(
        F.col("ledger_hit"),
        F.format_string(
            "ledger: sustained '%s' risk, turns %d-%d",
            F.col("_top_head"), F.coalesce(F.col("_first_risky"), F.col("n")), F.col("n"),
        ),
    )


def monitor(
    turns: DataFrame,
    window_scorer: WindowScorer,
    keys: Sequence[str] = ("conv_id",),
    order: str = "turn",
    text: str = "text",
    masked: str = "masked",
    settings: ConversationSettings = ConversationSettings(),
    block_rows: int | None = None,
) -> DataFrame:
    """G8. One row per user turn: action, scores, sticky first flag, reason and history. Never blocks.

    ``turns`` holds user turns with ``risk`` and ``head`` (see ``guard.turn_risk``). ``window_scorer``
    adds ``window_score, window_head`` from ``window_text`` and must yield 0.0 and '' where it is null.
    """
    keys = list(keys)
    slim = turns.select(
        *keys, order,
        # The joined window keeps its last characters only, so no turn can contribute more than that.
        F.right(F.col(text), F.lit(settings.window_max_chars)).alias("_raw"),
        F.right(F.col(masked), F.lit(settings.window_max_chars)).alias("_masked"),
        "risk", "head",
    )
    placed = placed_turns(slim, keys, order, settings, block_rows)
    windowed = with_window_text(placed, keys, order, "_raw", "_masked", settings).drop("_raw", "_masked")
    flagged = with_flags(window_scorer(windowed).drop("window_text"), keys, order, settings)
    return flagged.where(OWN).select(
        *keys, order,
        F.col("n").alias("user_turn"),
        F.when(F.col("flagged"), F.lit("flag")).otherwise(F.lit("allow")).alias("action"),
        "flagged", "window_hit", "ledger_hit", "risk", "head", "ledger",
        rounded(F.col("ledger"), 4).alias("score"),
        F.lit(settings.flag_threshold).alias("threshold"),
        rounded(F.col("window_score"), 4).alias("window_score"),
        "first_flagged_turn",
        _reason(settings).alias("reason"),
        "history",
    )


def flag_alerts(monitored: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """S13. One JSON line per flagged turn: ids and scores, never text."""
    return monitored.where("flagged").select(
        *keys, "user_turn",
        F.to_json(
            F.struct(
                F.lit("conversation_flag").alias("event"),
                F.col(keys[0]).cast("string").alias("conversation_id"),
                F.col("user_turn").alias("turn"),
                "score", "window_score", "first_flagged_turn", "reason",
            )
        ).alias("alert"),
    )
