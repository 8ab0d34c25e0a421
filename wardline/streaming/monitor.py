"""X1-X3. Conversation monitor as keyed state.

The heavy work (patterns, masks, scoring of single turns) happens before the keyed shuffle; the
stateful operator folds a slim row into a state of bounded size: counters plus the last turns kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.guard import guard, turn_risk
from wardline.operators.requests import accepted
from wardline.operators.scoring import BatchScorer
from wardline.settings import HEADS, ConversationSettings

#: What ``closed_conversations`` reads of a monitor's rows.
CLOSING = ("conversation_id", "ts", "user_turn", "flagged", "risk", "ledger", "first_flagged_turn")
#: The columns of closing rows.
CLOSED = ("conversation_id", "started", "ended", "n_turns", "worst_risk", "ledger", "flagged", "first_flagged_turn")

OUTPUT_SCHEMA = (
    "conversation_id STRING, ts TIMESTAMP, user_turn BIGINT, action STRING, flagged BOOLEAN, risk DOUBLE, ledger DOUBLE, "
    "score DOUBLE, threshold DOUBLE, window_score DOUBLE, first_flagged_turn BIGINT, reason STRING, "
    "history ARRAY<STRUCT<turn: BIGINT, risk: DOUBLE>>"
)
COLUMNS = tuple(x.split()[0] for x in OUTPUT_SCHEMA.replace("turn: BIGINT, ", "").split(", "))
_COUNTERS = "turns BIGINT, ledger DOUBLE, first_flagged BIGINT, last_seen BIGINT"
_KEPT = "turn BIGINT, masked STRING, risk DOUBLE, head STRING"
NONE = -1


class ConversationProcessor(StatefulProcessor):
    """State per conversation: counters, and the last turns kept (text only where a window still needs it)."""

    def __init__(self, load: Callable[[], BatchScorer] | None, settings: ConversationSettings, state_ttl_seconds: int | None,
                 columns: Sequence[str] | None = None):
        self._load, self._settings = load, settings
        self._columns = tuple(columns or COLUMNS)
        self._state_ttl_ms = state_ttl_seconds and state_ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counters = handle.getValueState("counters", _COUNTERS, self._state_ttl_ms)
        self._kept = handle.getListState("kept", _KEPT, self._state_ttl_ms)
        self._score = self._load() if self._load else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cfg = self._settings
        turns, ledger, first, seen = 0, 0.0, NONE, NONE
        if self._counters.exists():
            turns, ledger, first, seen = self._counters.get()
        # Nothing is kept of a conversation without counters; asking the store costs as much as folding some turns.
        kept = deque((tuple(x) for x in self._kept.get()) if turns else (), maxlen=cfg.turns_kept)
        # A key's rows of one micro-batch are folded in order, however many Arrow batches they came in.
        batches = list(rows)
        for chunk in [batches[0] if len(batches) == 1 else pd.concat(batches, ignore_index=True)] if batches else []:
            ts, place = chunk["ts"].array, chunk["turn"].to_numpy()
            order = np.lexsort((place, ts.to_numpy("datetime64[ns]"))) if place.dtype.kind in "if" else (
                chunk.reset_index(drop=True).sort_values(["ts", "turn"], kind="stable").index.to_numpy())
            ts = ts[order]
            raws, maskeds, risks, heads = (chunk[c].to_numpy()[order].tolist() for c in ("raw", "masked", "risk", "head"))
            plan = []
            # Window texts depend on texts and gaps only, so a chunk is scored in one call.
            texts, last = deque((x[1] for x in kept), maxlen=max(cfg.window_turns - 1, 1)), seen
            times = (ts.to_numpy("datetime64[ns]").astype(np.int64) // 1000).tolist()
            for at, raw, masked in zip(times, raws, maskeds):
                fresh = last != NONE and at - last > cfg.ttl_seconds * 1_000_000
                if fresh:
                    texts.clear()
                plan.append((at, fresh, masked, "\n".join([*texts, raw])[-cfg.window_max_chars:] if texts and cfg.window_turns > 1 else None))
                texts.append(masked)
                last = at
            scores = self._window_scores([p[3] for p in plan])
            # One list a column, and only of the columns asked for: a frame of rows costs several times as much.
            out = {c: [] for c in self._columns}
            shown = "history" in out
            for (at, fresh, masked, _), risk, head, (window_score, window_head) in zip(plan, risks, heads, scores):
                if fresh:
                    turns, ledger, first = 0, 0.0, NONE
                    kept.clear()
                turns += 1
                ledger = cfg.alpha * ledger + cfg.beta * risk
                kept.append((turns, masked, risk, head))
                seen = at
                verdict = self._verdict(kept, turns, ledger, window_score, window_head)
                if verdict["flagged"] and first == NONE:
                    first = turns
                row = {
                    "conversation_id": key[0], "user_turn": turns, **verdict, "risk": risk,
                    "ledger": ledger, "score": round(ledger, 4), "threshold": cfg.flag_threshold,
                    "window_score": round(window_score, 4),
                    "first_flagged_turn": None if first == NONE else first,
                    "history": [{"turn": t, "risk": round(r, 4)} for t, _, r, _ in list(kept)[-cfg.history_shown:]] if shown else None,
                }
                for c, values in out.items():
                    if c != "ts":
                        values.append(row[c])
            if "ts" in out:
                out["ts"] = ts
            if "first_flagged_turn" in out:
                out["first_flagged_turn"] = pd.array(out["first_flagged_turn"], "Int64")
            yield pd.DataFrame(out)
        self._counters.update((turns, ledger, first, seen))
        needed = turns - cfg.window_turns + 1
        self._kept.put([(t, m if t > needed else "", r, h) for t, m, r, h in kept])

    def _window_scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        wanted = [t for t in texts if t is not None]
        if not wanted or self._score is None:
            return [(0.0, "")] * len(texts)
        scored = self._score(pd.Series(wanted))
        heads = [h for h in HEADS if h in scored.columns]
        values = scored[heads].to_numpy(float)
        found = iter(zip(np.nanmax(values, axis=1).tolist(), [heads[i] for i in np.nanargmax(values, axis=1)]))
        return [next(found) if t is not None else (0.0, "") for t in texts]

    def _verdict(self, kept, n: int, ledger: float, window_score: float, window_head: str) -> dict:
        cfg = self._settings
        recent = list(kept)[-cfg.window_turns:]
        window_hit = (
            len(recent) > 1 and window_score >= cfg.threshold and max(t[2] for t in recent) < cfg.threshold
        )
        ledger_hit = ledger >= cfg.flag_threshold
        reason = None
        if window_hit:
            reason = f"window: '{window_head}' payload split across turns {recent[0][0]}-{n}"
        elif ledger_hit:
            since = next((t[0] for t in kept if t[2] >= cfg.risky_turn), n)
            worst = max(recent, key=lambda t: (t[2], -t[0]))[3]
            reason = f"ledger: sustained '{worst}' risk, turns {since}-{n}"
        flagged = window_hit or ledger_hit
        return {"action": "flag" if flagged else "allow", "flagged": flagged, "reason": reason}

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Select the state store the monitor needs; call before the stream starts."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def conversation_turns(requests: DataFrame, heads: str | None = None, settings: ConversationSettings = ConversationSettings()) -> DataFrame:
    """X3. One slim row per accepted request that names a conversation: only its last message counts.

    ``requests`` carries ``ts`` and ``turn`` (any number that orders requests of equal time).
    """
    risk, head = turn_risk()
    guarded = guard(accepted(requests).where(F.length("conversation_id") > 0), "user_text", heads, settings.threshold)
    last = F.lit(settings.window_max_chars)
    return guarded.select(
        "conversation_id", F.col("ts").cast("timestamp").alias("ts"), F.col("turn").cast("long").alias("turn"),
        F.right("user_text", last).alias("raw"), F.right("modified_content", last).alias("masked"),
        risk.alias("risk"), head.alias("head"),
    )


def monitor_stream(
    turns: DataFrame,
    load_scorer: Callable[[], BatchScorer] | None,
    settings: ConversationSettings = ConversationSettings(),
    state_ttl_seconds: int | None = None,
    lateness: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """X1, X2. Monitor rows for a stream of ``conversation_turns``.

    A key's slim rows of one micro-batch are held together, so bound micro-batches in the source
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Idle expiry compares event times and is refreshed by recorded turns only. ``state_ttl_seconds`` (wall
    clock) merely frees the state of conversations that never come back: set it, well above the longest
    stall, on a job that runs forever. Leave it out under an ``availableNow`` trigger, where clocked
    state would schedule empty batches without end. Needs the RocksDB state store. With ``lateness`` the rows carry a watermark that
    much behind the latest turn, older turns are dropped, and ``closed_conversations`` may follow. ``columns``: those of the rows
    that are wanted (all); history, which is most of a row, is then made only if it is one of them.
    """
    if state_ttl_seconds is not None and state_ttl_seconds < settings.ttl_seconds:
        raise ValueError("state_ttl_seconds must not be below the conversation TTL")
    if lateness and state_ttl_seconds:
        raise ValueError("clocked state and a watermark exclude each other")
    fields = {c: x for c, x in zip(COLUMNS, OUTPUT_SCHEMA.split(", ", len(COLUMNS) - 1))}
    timed = turns.withWatermark("ts", lateness) if lateness else turns
    return timed.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=ConversationProcessor(load_scorer, settings, state_ttl_seconds, columns),
        outputStructType=", ".join(fields[c] for c in columns or COLUMNS),
        outputMode="Append",
        timeMode="EventTime" if lateness else "ProcessingTime" if state_ttl_seconds else "None",
        eventTimeColumnName="ts" if lateness else "",
    )


def closed_conversations(monitored: DataFrame, settings: ConversationSettings = ConversationSettings()) -> DataFrame:
    """X2. One closing row (``CLOSED``) per conversation that has been idle longer than the TTL.

    ``monitored`` is a ``monitor_stream`` with ``lateness``, or its rows as a batch. A conversation's turns are merged while no
    gap is longer than the TTL, in whatever order they come; its row is written once, when the watermark has passed
    its last turn by the TTL. What is not idle yet stays in the state.
    """
    # A turn exactly one TTL later still belongs to the conversation, and windows exclude their end.
    idle = F.session_window("ts", f"{settings.ttl_seconds} seconds 1 microsecond").alias("_open")
    latest = F.struct("ts", "user_turn")
    closing = monitored.groupBy("conversation_id", idle).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_turns"),
        F.max("risk").alias("worst_risk"), F.max_by("ledger", latest).alias("ledger"),
        F.bool_or("flagged").alias("flagged"), F.min("first_flagged_turn").alias("first_flagged_turn"),
    )
    return closing.select(*CLOSED)
