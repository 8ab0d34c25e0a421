"""Queries over conversations and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from wardline.functions.pii import mask
from wardline.functions.text import collapse_spaces
from wardline.operators import conversation as V
from wardline.operators import requests as R
from wardline.operators import selection, sessions
from wardline.operators.blocks import OWN
from wardline.plans.lineage import cut
from wardline.settings import ConversationSettings

SETTINGS = ConversationSettings()
KEYS = ["conv_id"]


def payload_scorer(df: DataFrame) -> DataFrame:
    """A stand-in for a window model: only the assembled instruction looks like an injection."""
    seen = collapse_spaces(F.lower("window_text"))
    hit = F.contains(seen, F.lit("ignore")) & F.contains(seen, F.lit("previous instructions"))
    return df.withColumns({
        "window_score": F.when(F.col("window_text").isNull(), 0.0).when(hit, 0.95).otherwise(0.05),
        "window_head": F.when(F.col("window_text").isNull(), "").otherwise("prompt_injection"),
    })


def planted_turns(spark: SparkSession, sf: str) -> DataFrame:
    return R.user_turns(I.turns(spark, sf)).withColumn("masked", mask(F.col("text")))


def monitored(spark: SparkSession, sf: str) -> DataFrame:
    return V.monitor(planted_turns(spark, sf), payload_scorer)


def turn_numbers(spark: SparkSession, sf: str) -> DataFrame:
    placed = V.placed_turns(R.user_turns(I.turns(spark, sf)), KEYS, "turn", SETTINGS)
    return placed.where(OWN).select("conv_id", "turn", F.col("n").alias("user_turn"))


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    placed = V.placed_turns(planted_turns(spark, sf), KEYS, "turn", SETTINGS)
    return V.with_window_text(placed, KEYS, "turn", "text", "masked", SETTINGS).where(OWN)


def window_text(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf).select("conv_id", "turn", "window_text")


def window_score(spark: SparkSession, sf: str) -> DataFrame:
    return payload_scorer(_windowed(spark, sf)).select("conv_id", "turn", "window_score", "window_head")


def risk_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return monitored(spark, sf).select("conv_id", "turn", F.round("ledger", 9).alias("ledger"))


FLAG_COLUMNS = [
    "conv_id", "turn", "user_turn", "action", "flagged", "window_hit", "ledger_hit", "score", "threshold",
    "window_score", "first_flagged_turn", "reason",
]


def conversation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return monitored(spark, sf).select(*FLAG_COLUMNS)


def turn_history(spark: SparkSession, sf: str) -> DataFrame:
    return monitored(spark, sf).select("conv_id", "turn", F.inline("history").alias("hist_turn", "hist_risk"))


def flag_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = V.flag_alerts(monitored(spark, sf))
    return alerts.select(
        "conv_id", "user_turn", F.get_json_object("alert", "$.event").alias("event"),
        F.get_json_object("alert", "$.score").cast("double").alias("score"),
        F.get_json_object("alert", "$.first_flagged_turn").cast("long").alias("first_flagged_turn"),
        F.get_json_object("alert", "$.reason").alias("reason"),
    )


def kept_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.last_turns(I.turns(spark, sf), KEYS, "turn", keep=SETTINGS.turns_kept)
    return rows.select("conv_id", "turn", "role")


def sessionize(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(I.table(spark, sf, "events"), ["user_id"], "ts", SETTINGS.ttl_seconds)


def session_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.with_session(I.table(spark, sf, "events"), ["user_id"], "ts", SETTINGS.ttl_seconds)
    return rows.select("event_id", "user_id", "session")


def session_monitor(spark: SparkSession, sf: str) -> DataFrame:
    """The monitor over events as turns: users are conversations, idle gaps start new ones."""
    events = I.table(spark, sf, "events").select(
        "user_id", "event_id", "ts", (F.least(F.col("value"), F.lit(99.0)) / 100).alias("risk"),
        F.col("event_type").alias("head"), F.col("props").alias("text"), F.col("props").alias("masked"),
    )
    # The monitor reads its turns several times, so the sessions are found once.
    placed = cut(sessions.with_session(events, ["user_id"], "ts", SETTINGS.ttl_seconds).withColumn(
        "at_us", F.unix_micros(F.col("ts").cast("timestamp"))
    ))
    rows = V.monitor(placed, payload_scorer, ["user_id", "session"], "at_us")
    return rows.select(
        "user_id", "session", "at_us", "user_turn", "flagged", F.round("ledger", 9).alias("ledger"), "first_flagged_turn",
        "reason",
    )


def recent_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.recent_keys(I.table(spark, sf, "events"), "user_id", "ts", 100)
    return rows.select("user_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen"))


USERS = f"users AS (SELECT *, {I.mask_sql('text')} AS masked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns WHERE role = 'user')"
WINDOWED = """windowed AS (SELECT *, CASE WHEN n > 1 THEN right(array_to_string(
    list_append(list(masked) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), text),
    chr(10)), 2000) END AS window_text FROM users)"""
SEEN = I.spaces_sql("lower(window_text)")
WSCORED = f"""wscored AS (SELECT *, CASE WHEN window_text IS NULL THEN 0.0::DOUBLE
    WHEN contains({SEEN}, 'ignore') AND contains({SEEN}, 'previous instructions') THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS window_score,
    CASE WHEN window_text IS NULL THEN '' ELSE 'prompt_injection' END AS window_head FROM windowed)"""


def signals_sql(key: str, order: str, source: str) -> str:
    w = f"PARTITION BY {key} ORDER BY {order}"
    return f"""signals AS (SELECT *,
      list_reduce(list_prepend(0.0::DOUBLE, list(0.5::DOUBLE * risk) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
                  lambda a, x: 0.8::DOUBLE * a + x) AS ledger,
      count(*) OVER ({w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS in_window,
      max(risk) OVER ({w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS worst,
      list({{'r': risk, 'n': -n, 'h': head}}) OVER ({w} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent,
      min(CASE WHEN risk >= 0.2 THEN n END) OVER ({w} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS first_risky
    FROM {source}),
    hits AS (SELECT *, in_window > 1 AND window_score >= 0.5 AND worst < 0.5 AS window_hit, ledger >= 0.6::DOUBLE AS ledger_hit,
      list_max(recent).h AS top_head FROM signals),
    flags AS (SELECT *, window_hit OR ledger_hit AS flagged,
      min(CASE WHEN window_hit OR ledger_hit THEN n END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_flagged_turn,
      CASE WHEN window_hit THEN 'window: ''' || window_head || ''' payload split across turns ' || greatest(n - 3, 1) || '-' || n
           WHEN ledger_hit THEN 'ledger: sustained ''' || top_head || ''' risk, turns ' || coalesce(first_risky, n) || '-' || n END AS reason
    FROM hits)"""


CHAIN = (I.TURNS, USERS, WINDOWED, WSCORED)
FLAGS = (*CHAIN, signals_sql("conv_id", "turn", "wscored"))
ROUND4 = "printf('%.4f', {})::DOUBLE".format

GAPS = """gaps AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
sess AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM gaps)"""
SESSION_TURNS = """sturns AS (SELECT user_id, session, us AS at_us, least(value, 99.0) / 100 AS risk, event_type AS head, props AS text, props AS masked,
  row_number() OVER (PARTITION BY user_id, session ORDER BY us) AS n FROM sess),
swin AS (SELECT *, CASE WHEN n > 1 THEN right(array_to_string(list_append(
    list(masked) OVER (PARTITION BY user_id, session ORDER BY at_us ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), text), chr(10)), 2000) END AS window_text FROM sturns)"""

QUERIES = {
    "turn_numbers": turn_numbers,
    "window_text": window_text,
    "window_score": window_score,
    "risk_ledger": risk_ledger,
    "conversation_flags": conversation_flags,
    "turn_history": turn_history,
    "flag_alerts": flag_alerts,
    "kept_turns": kept_turns,
    "sessionize": sessionize,
    "session_rows": session_rows,
    "session_monitor": session_monitor,
    "recent_conversations": recent_conversations,
}
ORACLE = {
    "turn_numbers": I.ctes(I.TURNS, USERS) + "SELECT conv_id, turn, n AS user_turn FROM users",
    "window_text": I.ctes(*CHAIN) + "SELECT conv_id, turn, window_text FROM windowed",
    "window_score": I.ctes(*CHAIN) + "SELECT conv_id, turn, window_score, window_head FROM wscored",
    "risk_ledger": I.ctes(*FLAGS) + "SELECT conv_id, turn, round(ledger, 9) AS ledger FROM flags",
    "conversation_flags": I.ctes(*FLAGS) + f"""SELECT conv_id, turn, n AS user_turn,
        CASE WHEN flagged THEN 'flag' ELSE 'allow' END AS action, flagged, window_hit, ledger_hit,
        {ROUND4('ledger')} AS score, 0.6::DOUBLE AS threshold, {ROUND4('window_score')} AS window_score,
        first_flagged_turn, reason FROM flags""",
    "turn_history": I.ctes(
        *FLAGS, f"""h AS (SELECT conv_id, turn, unnest(list({{'t': n, 'r': {ROUND4('risk')}}}) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS x FROM flags)"""
    ) + "SELECT conv_id, turn, x.t AS hist_turn, x.r AS hist_risk FROM h",
    "flag_alerts": I.ctes(*FLAGS) + f"""SELECT conv_id, n AS user_turn, 'conversation_flag' AS event,
        {ROUND4('ledger')} AS score, first_flagged_turn, reason FROM flags WHERE flagged""",
    "kept_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 50",
    "sessionize": I.ctes(GAPS) + "SELECT user_id, session, min(us) AS started, max(us) AS ended, count(*) AS n FROM sess GROUP BY user_id, session",
    "session_rows": I.ctes(GAPS) + "SELECT event_id, user_id, session FROM sess",
    "session_monitor": I.ctes(
        GAPS, SESSION_TURNS, WSCORED.replace("FROM windowed", "FROM swin"), signals_sql("user_id, session", "at_us", "wscored")
    ) + "SELECT user_id, session, at_us, n AS user_turn, flagged, round(ledger, 9) AS ledger, first_flagged_turn, reason FROM flags",
    "recent_conversations": "SELECT user_id, epoch_us(max(ts)) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, user_id LIMIT 100",
}
