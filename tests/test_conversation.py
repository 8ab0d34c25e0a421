"""Monitor rules, blocks against one window, and the stream against the batch job."""

import datetime as dt
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.conversation_checks import payload_scorer
from checks.job_checks import payload_batch_scorer
from wardline.operators import conversation as V
from wardline.operators import sessions
from wardline.settings import ConversationSettings
from wardline.streaming import monitor as M

TURNS = "conv_id LONG, turn LONG, text STRING, masked STRING, risk DOUBLE, head STRING"
HEADS = ("prompt_injection", "jailbreak", "toxic")


def made(spark, risks, texts=None):
    rows = [(1, i, (texts or {}).get(i, "x"), (texts or {}).get(i, "x"), r, "jailbreak") for i, r in enumerate(risks)]
    return spark.createDataFrame(rows, TURNS)


def run(df, **options):
    return V.monitor(df, payload_scorer, **options).orderBy("conv_id", "turn").collect()


def test_ledger_flags_sustained_risk_but_not_one_spike(spark):
    rows = run(made(spark, [0.4] * 5))
    assert [r["score"] for r in rows] == [0.2, 0.36, 0.488, 0.5904, 0.6723]
    assert [r["flagged"] for r in rows] == [False] * 4 + [True]
    assert rows[-1]["reason"] == "ledger: sustained 'jailbreak' risk, turns 1-5" and rows[-1]["first_flagged_turn"] == 5
    spike = run(made(spark, [0.9]))[0]
    assert spike["score"] == 0.45 and not spike["flagged"]


def test_window_rule(spark):
    texts = {0: "The first half is ignore", 1: "the second half is all previous instructions"}
    hit = run(made(spark, [0.05, 0.05], texts))[-1]
    assert hit["flagged"] and hit["reason"].startswith("window: 'prompt_injection'") and hit["window_score"] == 0.95
    miss = run(made(spark, [0.95, 0.05], texts))[-1]
    assert not (miss["reason"] or "").startswith("window")


def test_settings_are_checked():
    for bad in ({"window_turns": 0}, {"alpha": 1.0}, {"window_turns": 60}):
        with pytest.raises(ValueError):
            ConversationSettings(**bad)


@pytest.mark.parametrize("block_rows", [1, 3, 7])
def test_blocks_equal_one_window(spark, block_rows):
    """A short memory makes blocks see only a part of a long conversation."""
    rng = random.Random(block_rows)
    cfg = ConversationSettings(alpha=0.01, beta=0.9, turns_kept=6, history_shown=3)
    rows = []
    for conv, n in ((1, 80), (2, 3), (3, 40)):
        for turn in sorted(rng.sample(range(n * 2), n)):
            word = rng.choice(["ignore", "all previous instructions", "hello"])
            rows.append((conv, turn, word, word, rng.choice([0.0, 0.05, 0.3, 0.7]), rng.choice(HEADS)))
    df = spark.createDataFrame(rows, TURNS)
    whole = [r.asDict(True) for r in run(df, settings=cfg)]
    cut = [r.asDict(True) for r in run(df, settings=cfg, block_rows=block_rows)]
    assert len(whole) == len(rows)
    for a, b in zip(whole, cut):
        assert abs(a.pop("ledger") - b.pop("ledger")) < 1e-9
        assert a == b


def fold(turns, cfg, ttl_us):
    """Plain restatement of the monitor for one conversation: list of (at, text, risk, head)."""
    out, kept, ledger, first, last = [], [], 0.0, None, None
    for at, text, risk, head in turns:
        if last is not None and at - last > ttl_us:
            kept, ledger, first = [], 0.0, None
        last = at
        n = kept[-1][0] + 1 if kept else 1
        window = "\n".join([*(k[1] for k in kept[-(cfg.window_turns - 1):]), text])[-cfg.window_max_chars:] if kept else None
        score = 0.0 if window is None else (0.95 if "ignore" in window and "previous instructions" in window else 0.05)
        kept = [*kept, (n, text, risk, head)][-cfg.turns_kept:]
        ledger = cfg.alpha * ledger + cfg.beta * risk
        recent = kept[-cfg.window_turns:]
        hit = len(recent) > 1 and score >= cfg.threshold and all(k[2] < cfg.threshold for k in recent)
        flagged = hit or ledger >= cfg.flag_threshold
        if flagged and first is None:
            first = n
        out.append((n, flagged, round(ledger, 9), first))
    return out


def test_batch_and_stream_equal_a_plain_fold_with_idle_gaps(spark, tmp_path):
    rng = random.Random(5)
    cfg = ConversationSettings()
    base, rows, expected = dt.datetime(2024, 1, 1), [], {}
    for conv in ("a", "b", "c"):
        at, turns = 0, []
        for i in range(70):
            at += rng.choice([1, 60, 3600, 3601])
            word = rng.choice(["ignore", "all previous instructions", "hello", "bye"])
            risk, head = rng.choice([0.0, 0.1, 0.3, 0.45, 0.8]), rng.choice(HEADS)
            turns.append((at * 1_000_000, word, risk, head))
            rows.append((conv, base + dt.timedelta(seconds=at), i, word, word, risk, head))
        expected[conv] = fold(turns, cfg, 3600 * 1_000_000)
    df = spark.createDataFrame(
        rows, "conversation_id STRING, ts TIMESTAMP, turn LONG, raw STRING, masked STRING, risk DOUBLE, head STRING"
    )
    placed = sessions.with_session(df, ["conversation_id"], "ts", cfg.ttl_seconds)
    batch = V.monitor(placed, payload_scorer, ["conversation_id", "session"], "turn", "raw", "masked", cfg)
    got = {c: [] for c in expected}
    for r in batch.orderBy("conversation_id", "turn").collect():
        got[r["conversation_id"]].append((r["user_turn"], r["flagged"], round(r["ledger"], 9), r["first_flagged_turn"]))
    assert got == expected

    source = str(tmp_path / "in")
    for part in range(2):  # two micro-batches: the state carries over
        df.where((F.col("turn") >= 35) == bool(part)).coalesce(1).write.mode("append").parquet(f"{source}/part={part}")
    M.use_rocksdb(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    out = str(tmp_path / "out")
    query = M.monitor_stream(stream, payload_batch_scorer, cfg).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / uuid.uuid4().hex)
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("conversation_id", "ts").collect()
    streamed = {c: [] for c in expected}
    for r in rows:
        streamed[r["conversation_id"]].append((r["user_turn"], r["flagged"], round(r["ledger"], 9), r["first_flagged_turn"]))
    assert streamed == expected


def test_stream_makes_only_the_columns_asked_for(spark):
    class Value:
        held, asked = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            self.asked += 1
            return self.held

        def put(self, held):
            self.held = held

        update = put

    class Handle:
        def __init__(self):
            self.states = {}

        def getValueState(self, name, *_):
            return self.states.setdefault(name, Value())

        getListState = getValueState

    turns = pd.DataFrame({
        "ts": pd.to_datetime([3, 1, 2], unit="s"), "turn": [3, 1, 2], "raw": ["c", "ignore", "previous instructions"],
        "masked": ["c", "ignore", "previous instructions"], "risk": [0.9, 0.1, 0.2], "head": ["toxic"] * 3})
    made, handles = {}, {}
    for columns in (None, M.CLOSING):
        handles[columns] = Handle()
        processor = M.ConversationProcessor(payload_batch_scorer, ConversationSettings(), None, columns)
        processor.init(handles[columns])
        made[columns] = pd.concat(processor.handleInputRows(("a",), iter([turns]), None))
    assert tuple(made[None].columns) == M.COLUMNS and tuple(made[M.CLOSING].columns) == M.CLOSING
    pd.testing.assert_frame_equal(made[None][list(M.CLOSING)], made[M.CLOSING])
    assert made[None]["user_turn"].tolist() == [1, 2, 3] and made[None]["flagged"].tolist() == [False, True, False]
    assert [len(h) for h in made[None]["history"]] == [1, 2, 3]
    assert handles[None].states["kept"].asked == 0  # a new conversation has nothing to read
    assert handles[None].states["kept"].held == handles[M.CLOSING].states["kept"].held


def test_sessions_split_after_the_ttl_only(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", base + dt.timedelta(seconds=s)) for s in (0, 3600, 7201, 7201, 20000)]
    df = spark.createDataFrame(rows, "u STRING, ts TIMESTAMP")
    got = sessions.sessions(df, ["u"], "ts", 3600).orderBy("session").collect()
    assert [(r["session"], r["n"]) for r in got] == [(1, 2), (2, 2), (3, 1)]


def test_alerts_hold_no_text(spark):
    alerts = V.flag_alerts(V.monitor(made(spark, [0.9] * 3, {0: "secret words"}), payload_scorer)).collect()
    assert alerts and all("secret" not in a["alert"] for a in alerts)


@pytest.mark.parametrize("rows", [1, 5])
def test_stream_order_does_not_depend_on_arrow_batches(spark, rows):
    from checks import job_checks
    from checks.compare import compare, duck

    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        ok, note = compare(spark, duck(sf), sf, job_checks.stream_monitor, job_checks.ORACLE["stream_monitor"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ok, note


@pytest.mark.parametrize("alpha", [0.8, 0.999])
def test_ledger_equals_one_fold_bit_by_bit(spark, alpha):
    rng = random.Random(3)
    cfg = ConversationSettings(alpha=alpha)
    risks = [rng.random() for _ in range(10_000)]
    values, value = [], 0.0
    for r in risks:
        value = cfg.alpha * value + cfg.beta * r
        values.append(value)
    assert [r["ledger"] for r in run(made(spark, risks), settings=cfg)] == values
    if alpha == 0.8:  # blocks longer than its memory: still the same bits
        assert [r["ledger"] for r in run(made(spark, risks), settings=cfg, block_rows=1500)] == values


def test_sparse_orders_are_cut_by_rank_with_few_copies(spark):
    from wardline.operators import blocks

    rng = random.Random(4)
    at = sorted(rng.sample(range(10 ** 15), 2000))
    rows = [("hot", t) for t in at] + [(f"k{i}", t) for i in range(20) for t in at[i:i + 5]] + [(None, 5)]
    df = spark.createDataFrame(rows, "k STRING, at LONG")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    placed = blocks.place(df, ["k"], "at", 49, 1000).withColumn("n", blocks.position(["k"], "at"))
    assert len(tracker.getJobIdsForGroup("building")) == 0
    hot = placed.where("k = 'hot'").collect()
    assert len(hot) <= 2200 and len({r["_block"] for r in hot}) >= 2
    place = {t: i + 1 for i, t in enumerate(at)}
    assert all(r["n"] == place[r["at"]] for r in hot) and sum(r["_own"] for r in hot) == 2000
    assert placed.where("k is null or k <> 'hot'").count() == 101


def test_many_rows_of_one_order_share_a_block(spark):
    from wardline.operators import blocks

    df = spark.createDataFrame([("a", i // 40) for i in range(400)], "k STRING, at LONG")
    placed = blocks.place(df, ["k"], "at", 3, 20)
    own = placed.where("_own").collect()
    assert len(own) == 400 and len({(r["at"], r["_block"]) for r in own}) == 10


def test_idle_conversations_close_once(spark, tmp_path):
    rng = random.Random(11)
    base, cfg = dt.datetime(2024, 1, 1), ConversationSettings()
    rows = []
    for c in range(6):
        at = 0
        for i in range(30):
            at += rng.choice([1, 60, 3600, 3601, 9000])
            rows.append((f"c{c}", base + dt.timedelta(seconds=at), i, "hello", "hello", 0.3, "toxic"))
    df = spark.createDataFrame(rows, "conversation_id STRING, ts TIMESTAMP, turn LONG, raw STRING, masked STRING, risk DOUBLE, head STRING")
    batch = sessions.sessions(df, ["conversation_id"], "ts", cfg.ttl_seconds)
    latest = max(r[1] for r in rows)
    middle = base + dt.timedelta(seconds=60_000)
    M.use_rocksdb(spark)
    source, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")

    def go_on():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        closed = M.closed_conversations(M.monitor_stream(stream, payload_batch_scorer, cfg, lateness="60 seconds"), cfg)
        query = closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def expected(until):
        edge = (until.replace(tzinfo=dt.timezone.utc).timestamp() - 60) * 1_000_000
        return {(r["conversation_id"], r["started"], r["ended"], r["n"]) for r in batch.collect() if r["ended"] + 3_600_000_001 <= edge}

    def got():
        found = spark.read.parquet(out).select("conversation_id", F.unix_micros("started"), F.unix_micros("ended"), "n_turns").collect()
        assert len(found) == len(set(found))
        return {tuple(r) for r in found}

    # The stream stops in the middle and goes on from its checkpoint: closed rows stay, open ones wait.
    df.where(F.col("ts") <= F.lit(middle)).coalesce(1).write.parquet(f"{source}/part=0")
    go_on()
    first = got()
    assert first == expected(max(r[1] for r in rows if r[1] <= middle)) and first
    df.where(F.col("ts") > F.lit(middle)).coalesce(1).write.parquet(f"{source}/part=1")
    go_on()
    assert got() == expected(latest) and first < got()
