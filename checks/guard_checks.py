"""Queries over normalization, detectors, masks, decisions and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from wardline.functions import patterns as P
from wardline.functions import pii, text
from wardline.functions.detectors import first_match
from wardline.functions.perturb import PERTURBATIONS, ZERO_WIDTH_SPACE, _FULLWIDTH, _PRINTABLE
from wardline.operators import guard as G
from wardline.operators import requests as R
from wardline.operators.scoring import heads_map
from wardline.settings import HEADS


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.with_normalized(I.docs(spark, sf), "text", "norm").select("doc_id", "norm")


def _detect(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        normed = text.with_normalized(I.docs(spark, sf), "text", "norm")
        return normed.withColumn("matched", first_match(F.col("norm"), name)).select(
            "doc_id", "matched", (F.col("matched") != "").alias("blocked")
        )

    return run


def _detect_sql(name: str) -> str:
    return I.ctes(I.DOCS, I.NORMED, I.MATCHED) + (
        f"SELECT doc_id, {name}_match AS matched, {name}_match <> '' AS blocked FROM matched"
    )


def mask_pii(spark: SparkSession, sf: str) -> DataFrame:
    masked = pii.with_masked(I.docs(spark, sf))
    return masked.select(
        "doc_id", F.col("masked").alias("masked_text"),
        *[F.col("pii_counts")[k].alias(f"n_{k.lower()}") for k in pii.KINDS],
        pii.pii_result(F.col("pii_counts"))["action"].alias("action"),
    )


_ANY_PII = " + ".join(f"n_{k.lower()}" for k in P.PII) + " > 0"
MASK_PII_SQL = I.ctes(I.DOCS, I.NORMED, I.MATCHED, I.MASKED) + (
    "SELECT doc_id, masked_text, " + ", ".join(f"n_{k.lower()}" for k in P.PII)
    + f", CASE WHEN {_ANY_PII} THEN 'modify' ELSE 'allow' END AS action FROM masked"
)


def _flat_decision(guarded: DataFrame) -> DataFrame:
    return guarded.select(
        "doc_id", "passed", "score", "action", "reason", "modified_content",
        *[F.col(f"{c}_result.action").alias(f"{c}_action") for c in (*G.PATTERN_CHECKS, "pii", "ml_classifier")],
    )


def guard_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_decision(G.guard(I.docs(spark, sf)))


_PII_REASON = "'PII detected and redacted: ' || concat_ws(', ', " + ", ".join(
    f"CASE WHEN n_{k.lower()} > 0 THEN '{k} x' || n_{k.lower()} END" for k in P.PII
) + ")"


def _decision_sql(source: str, ml_block: str, ml_score: str, ml_reason: str) -> str:
    blocks = [(f"{c}_match <> ''", f"'{P.HIT_REASON[c]}: ''' || {c}_match || ''''", "0.0::DOUBLE") for c in G.PATTERN_CHECKS]
    blocks.append((ml_block, ml_reason, ml_score))
    any_block = " OR ".join(f"({b[0]})" for b in blocks)
    reason = " ".join(f"WHEN {b} THEN {r}" for b, r, _ in blocks)
    score = " ".join(f"WHEN {b} THEN {s}" for b, _, s in blocks)
    return f"""SELECT doc_id, NOT ({any_block}) AS passed,
      CASE {score} WHEN {_ANY_PII} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score,
      CASE WHEN {any_block} THEN 'block' WHEN {_ANY_PII} THEN 'modify' ELSE 'allow' END AS action,
      CASE {reason} WHEN {_ANY_PII} THEN {_PII_REASON} ELSE '{G.CLEAR}' END AS reason,
      masked_text AS modified_content,
      {', '.join(f"CASE WHEN {c}_match <> '' THEN 'block' ELSE 'allow' END AS {c}_action" for c in G.PATTERN_CHECKS)},
      CASE WHEN {_ANY_PII} THEN 'modify' ELSE 'allow' END AS pii_action,
      CASE WHEN {ml_block} THEN 'block' ELSE 'allow' END AS ml_classifier_action
    FROM {source}"""


GUARD_SQL = I.ctes(I.DOCS, I.NORMED, I.MATCHED, I.MASKED) + _decision_sql("masked", "false", "1.0::DOUBLE", "''")


def guard_decision_ml(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.scored(spark, sf).withColumn("heads", heads_map())
    return _flat_decision(G.guard(rows.select("doc_id", "text", "heads"), heads="heads"))


_SCORED_CHAIN = (I.DOCS, I.LABELLED, I.SCORED)
_TOP_HEAD = (
    "CASE WHEN prompt_injection >= jailbreak AND prompt_injection >= toxic_p THEN 'prompt_injection' "
    "WHEN jailbreak >= toxic_p THEN 'jailbreak' ELSE 'toxic' END"
)
_SCORED_MASKED = (
    *_SCORED_CHAIN,
    f"normed AS (SELECT *, {I.norm_sql('text')} AS norm, {_TOP_HEAD} AS top_head FROM scored)", I.MATCHED, I.MASKED,
)
_ML_REASON = "'ML classifier flagged ''' || top_head || ''' (p=' || printf('%.2f', top_p) || ')'"
GUARD_ML_SQL = I.ctes(*_SCORED_MASKED) + _decision_sql("masked", "top_p >= 0.5", "1.0::DOUBLE - top_p", _ML_REASON)


def action_counts(spark: SparkSession, sf: str) -> DataFrame:
    guarded = G.guard(I.docs(spark, sf))
    return guarded.groupBy("lang", "action").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


ACTION_COUNTS_SQL = GUARD_SQL.replace("SELECT doc_id, NOT (", "SELECT lang, action, count(*) AS n, avg(score) AS mean_score FROM (SELECT doc_id, lang, NOT (", 1) + ") GROUP BY lang, action"


def ml_verdict(spark: SparkSession, sf: str) -> DataFrame:
    result = G.ml_result(heads_map(), 0.5)
    rows = I.scored(spark, sf).withColumn("r", result)
    return rows.select(
        "doc_id", "r.passed", "r.score", "r.action", "r.reason", *[F.col("r.heads")[h].alias(f"p_{h}") for h in HEADS]
    )


ML_VERDICT_SQL = I.ctes(*_SCORED_CHAIN) + f"""SELECT doc_id, NOT blocked AS passed, 1.0::DOUBLE - top_p AS score,
  CASE WHEN blocked THEN 'block' ELSE 'allow' END AS action,
  CASE WHEN blocked THEN {_ML_REASON.replace('top_head', f'({_TOP_HEAD})')}
       ELSE 'ML classifier: no head above threshold (max ''' || ({_TOP_HEAD}) || ''' p=' || printf('%.2f', top_p) || ')' END AS reason,
  round(prompt_injection, 4) AS p_prompt_injection, round(jailbreak, 4) AS p_jailbreak, round(toxic_p, 4) AS p_toxic
FROM scored"""


def ml_verdict_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Class scores are turned into shares of their sum, as a four-class model would give."""
    names = ("jailbreak", "prompt_injection", "safe", "toxic")
    rows = I.scored(spark, sf).withColumn("safe", F.lit(1.0) - F.col("top_p"))
    total = F.col("jailbreak") + F.col("prompt_injection") + F.col("safe") + F.col("toxic")
    shares = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n) / total)])
    return rows.select("doc_id", G.multiclass_result(shares, 0.5, names).alias("r")).select(
        "doc_id", "r.passed", "r.score", "r.action", "r.reason"
    )


MULTICLASS_SQL = I.ctes(
    *_SCORED_CHAIN,
    "c AS (SELECT *, 1.0::DOUBLE - top_p AS safe FROM scored)",
    "t AS (SELECT doc_id, jailbreak / s AS j, prompt_injection / s AS i, safe / s AS f, toxic_p / s AS x FROM "
    "(SELECT *, jailbreak + prompt_injection + safe + toxic_p AS s FROM c))",
    "b AS (SELECT *, greatest(j, i, f, x) AS p, CASE WHEN j = greatest(j, i, f, x) THEN 'jailbreak' "
    "WHEN i = greatest(j, i, f, x) THEN 'prompt_injection' WHEN f = greatest(j, i, f, x) THEN 'safe' ELSE 'toxic' END AS head FROM t)",
) + """SELECT doc_id, NOT (head <> 'safe' AND p >= 0.5) AS passed, f AS score,
  CASE WHEN head <> 'safe' AND p >= 0.5 THEN 'block' ELSE 'allow' END AS action,
  'ML classifier predicted ''' || head || ''' (confidence ' || printf('%.2f', p) || ')' AS reason FROM b"""


def turn_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.scored(spark, sf).withColumn("heads", heads_map())
    risk, head = G.turn_risk()
    return G.guard(rows.select("doc_id", "text", "heads"), heads="heads").select(
        "doc_id", F.round(risk, 9).alias("risk"), head.alias("head")
    )


TURN_RISK_SQL = I.ctes(*_SCORED_MASKED) + """SELECT doc_id,
  CASE WHEN prompt_injection_match <> '' OR jailbreak_match <> '' OR toxic_content_match <> '' THEN 1.0::DOUBLE
       ELSE round(1.0::DOUBLE - (1.0::DOUBLE - top_p), 9) END AS risk,
  CASE WHEN prompt_injection_match <> '' THEN 'prompt_injection' WHEN jailbreak_match <> '' THEN 'jailbreak'
       WHEN toxic_content_match <> '' THEN 'toxic' ELSE top_head END AS head FROM masked"""


def guard_response(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.scored(spark, sf).withColumn("heads", heads_map())
    guarded = G.guard(rows.select("doc_id", "text", "heads"), heads="heads")
    return guarded.select("doc_id", G.guard_response().alias("r")).select(
        "doc_id", "r.blocked", "r.reason", "r.response", F.col("r.ml_classifier.action").alias("ml_action"),
        F.col("r.ml_classifier.score").alias("ml_score"),
    )


GUARD_RESPONSE_SQL = I.ctes(
    *_SCORED_MASKED, "d AS (" + _decision_sql("masked", "top_p >= 0.5", "1.0::DOUBLE - top_p", _ML_REASON) + ")"
) + """SELECT d.doc_id, action = 'block' AS blocked, reason,
  CASE WHEN action = 'block' THEN '' ELSE '[LLM call skipped]' END AS response,
  ml_classifier_action AS ml_action, 1.0::DOUBLE - top_p AS ml_score FROM d JOIN scored s ON d.doc_id = s.doc_id"""


# -- requests ----------------------------------------------------------------------------------------
def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per turn, of a shape that depends on the turn: prompts, message lists, and malformed ones."""
    rows = I.turns(spark, sf)
    one = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    two = F.array(
        F.struct(F.lit("assistant").alias("role"), F.lit("Hello.").alias("content")),
        F.struct(F.col("role").alias("role"), F.col("text").alias("content")),
    )
    kind = F.col("turn") % 4
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 0, F.col("text")).when((kind == 3) & (F.col("conv_id") % 2 == 0), F.col("text")).alias("prompt"),
        F.when(kind == 1, one).when(kind == 2, two).when((kind == 3) & (F.col("conv_id") % 4 == 0), one).alias("messages"),
        F.col("conv_id").cast("string").alias("conversation_id"),
    )


def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    checked = R.validate(_requests(spark, sf))
    return checked.select(
        "conv_id", "turn", "error", F.when(F.col("error").isNull(), R.user_text()).alias("user_text")
    )


VALIDATE_SQL = I.ctes(I.TURNS, """req AS (
  SELECT conv_id, turn, role, text, turn % 4 AS kind,
    (turn % 4 = 0) OR (turn % 4 = 3 AND conv_id % 2 = 0) AS has_prompt,
    (turn % 4 IN (1, 2)) OR (turn % 4 = 3 AND conv_id % 4 = 0) AS has_messages FROM turns)""",
    f"""v AS (SELECT *, CASE WHEN has_prompt = has_messages THEN {I.lit(R.ONE_INPUT)}
    WHEN has_messages AND role <> 'user' THEN {I.lit(R.LAST_USER)} END AS error FROM req)""") + (
    "SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN text END AS user_text FROM v"
)


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return R.user_turns(I.turns(spark, sf)).select("conv_id", "turn", "text")


USER_TURNS_SQL = I.ctes(I.TURNS) + "SELECT conv_id, turn, text FROM turns WHERE role = 'user'"


def outbound_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Each planted document sent behind a system message, an earlier user turn and an assistant turn."""
    rows = I.docs(spark, sf)

    def message(role: str, content) -> object:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    contact = F.lit("Reach me at jane@example.org or 555-987-6543.")
    messages = F.array(
        message("system", contact), message("user", contact), message("assistant", contact), message("user", F.col("text"))
    )
    sent = rows.select("doc_id", R.outbound_messages(messages).alias("messages"))
    return sent.select("doc_id", F.posexplode("messages").alias("place", "m")).select(
        "doc_id", "place", "m.role", "m.content"
    )


_CONTACT = "'Reach me at jane@example.org or 555-987-6543.'"
OUTBOUND_SQL = I.ctes(I.DOCS) + f"""
SELECT doc_id, 0 AS place, 'system' AS role, {_CONTACT} AS content FROM docs
UNION ALL SELECT doc_id, 1, 'user', {I.mask_sql(_CONTACT)} FROM docs
UNION ALL SELECT doc_id, 2, 'assistant', {_CONTACT} FROM docs
UNION ALL SELECT doc_id, 3, 'user', {I.mask_sql('text')} FROM docs"""


# -- text functions ----------------------------------------------------------------------------------
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return I.docs(spark, sf).select("doc_id", F.posexplode(text.segments(F.col("text"))).alias("seg", "sentence"))


SEGMENTS = r"""pieces AS (
  SELECT doc_id, text, list_filter(
    string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
    lambda s: regexp_matches(s, '\S')) AS parts FROM docs),
segs AS (SELECT doc_id, unnest(range(len(all_parts))) AS seg, unnest(all_parts) AS sentence FROM (
  SELECT doc_id, CASE WHEN len(parts) > 1 THEN list_prepend(text, parts) ELSE [text] END AS all_parts FROM pieces))"""
SENTENCES_SQL = I.ctes(I.DOCS, SEGMENTS) + "SELECT doc_id, seg::INT AS seg, sentence FROM segs"


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids are word lengths between two special ids."""
    words = F.transform(F.split("text", " "), lambda w: F.char_length(w))
    ids = F.concat(F.array(F.lit(0)), words, F.array(F.lit(99)))
    windows = I.docs(spark, sf).select("doc_id", F.posexplode(text.token_windows(ids, 130)).alias("place", "w"))
    return windows.select(
        "doc_id", "place", F.size("w").alias("n"),
        F.md5(F.array_join(F.transform("w", lambda i: i.cast("string")), ",")).alias("ids_md5"),
    )


TOKEN_WINDOWS_SQL = I.ctes(
    I.DOCS,
    "t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS body FROM docs)",
    "s AS (SELECT doc_id, body, len(body) AS n, range(0, greatest(len(body) - 128, 0) + 1, 64) AS starts FROM t)",
    "p AS (SELECT doc_id, body, CASE WHEN n > 128 AND starts[-1] + 128 < n AND len(starts) < 8 "
    "THEN list_append(starts, n - 128) ELSE starts[1:8] END AS picked FROM s)",
    "e AS (SELECT doc_id, body, unnest(range(len(picked))) AS place, unnest(picked) AS b FROM p)",
    "w AS (SELECT doc_id, place, list_concat(list_concat([0], body[b + 1 : b + 128]), [99]) AS w FROM e)",
) + "SELECT doc_id, place::INT AS place, len(w)::INT AS n, md5(array_to_string(w, ',')) AS ids_md5 FROM w"


def perturb(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.docs(spark, sf)
    sides = F.array(*[F.struct(F.lit(n).alias("perturbation"), fn(F.col("text")).alias("t")) for n, fn in PERTURBATIONS.items()])
    return rows.select("doc_id", F.inline(sides)).select("doc_id", "perturbation", "t", F.length("t").alias("n")).drop("n").withColumnRenamed("t", "rewritten")


_WORDS = f"string_split({I.spaces_sql('text')}, ' ')"
_TYPO = r"""array_to_string(list_transform(words, lambda w, i: CASE WHEN length(w) > 4
  AND ('0x' || substr(md5((i - 1)::VARCHAR || ':' || w), 1, 4))::INT / 65536.0::DOUBLE < 0.3 THEN
  substr(w, 1, ('0x' || substr(md5((i - 1)::VARCHAR || ':' || w), 5, 4))::INT % (length(w) - 3) + 1)
  || substr(w, ('0x' || substr(md5((i - 1)::VARCHAR || ':' || w), 5, 4))::INT % (length(w) - 3) + 3, 1)
  || substr(w, ('0x' || substr(md5((i - 1)::VARCHAR || ':' || w), 5, 4))::INT % (length(w) - 3) + 2, 1)
  || substr(w, ('0x' || substr(md5((i - 1)::VARCHAR || ':' || w), 5, 4))::INT % (length(w) - 3) + 4)
  ELSE w END), ' ')"""
# DuckDB upper-cases the German sharp s to itself, Unicode full case mapping gives SS.
PERTURB_SQL = I.ctes(I.DOCS, f"w AS (SELECT doc_id, text, {_WORDS} AS words FROM docs)") + f"""
SELECT doc_id, 'uppercase' AS perturbation, upper(replace(text, 'ß', 'ss')) AS rewritten FROM w
UNION ALL SELECT doc_id, 'leetspeak', translate(lower(text), '{P.PERTURB_LEET_FROM}', '{P.PERTURB_LEET_TO}') FROM w
UNION ALL SELECT doc_id, 'typos', {_TYPO} FROM w
UNION ALL SELECT doc_id, 'extra_spaces', array_to_string(words, '  ') FROM w
UNION ALL SELECT doc_id, 'benign_padding', {I.lit(P.PADDING_BEFORE)} || text || {I.lit(P.PADDING_AFTER)} FROM w
UNION ALL SELECT doc_id, 'fullwidth', translate(text, {I.lit(_PRINTABLE)}, {I.lit(_FULLWIDTH)}) FROM w
UNION ALL SELECT doc_id, 'zero_width', array_to_string(list_transform(words,
  lambda w: array_to_string(string_split(w, ''), {I.lit(ZERO_WIDTH_SPACE)})), ' ') FROM w"""


def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    tuned = {"prompt_injection": 0.62, "jailbreak": 0.35, "toxic": 0.5}
    rows = I.scored(spark, sf)
    inside = [F.least(F.greatest(F.col(h), F.lit(0.001)), F.lit(0.999)) for h in HEADS]
    return rows.select(
        "doc_id", *[F.round(text.calibrate(p, F.lit(tuned[h])), 9).alias(h) for h, p in zip(HEADS, inside)]
    )


def _calibrate_sql(column: str, t: float) -> str:
    p = f"least(greatest({column}, 0.001::DOUBLE), 0.999::DOUBLE)"
    return f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln({p} / (1.0::DOUBLE - {p})) - ln({t}::DOUBLE / (1.0::DOUBLE - {t}::DOUBLE))))), 9)"


CALIBRATE_SQL = I.ctes(*_SCORED_CHAIN) + (
    f"SELECT doc_id, {_calibrate_sql('prompt_injection', 0.62)} AS prompt_injection, "
    f"{_calibrate_sql('jailbreak', 0.35)} AS jailbreak, {_calibrate_sql('toxic_p', 0.5)} AS toxic FROM scored"
)

QUERIES = {
    "normalize_text": normalize_text,
    "detect_injection": _detect("prompt_injection"),
    "detect_jailbreak": _detect("jailbreak"),
    "detect_toxic": _detect("toxic_content"),
    "mask_pii": mask_pii,
    "guard_decision": guard_decision,
    "guard_decision_ml": guard_decision_ml,
    "action_counts": action_counts,
    "ml_verdict": ml_verdict,
    "ml_verdict_multiclass": ml_verdict_multiclass,
    "turn_risk": turn_risk,
    "guard_response": guard_response,
    "validate_requests": validate_requests,
    "user_turns": user_turns,
    "outbound_messages": outbound_messages,
    "split_sentences": split_sentences,
    "token_windows": token_windows,
    "perturb": perturb,
    "calibrate": calibrate,
}
ORACLE = {
    "normalize_text": I.ctes(I.DOCS, I.NORMED) + "SELECT doc_id, norm FROM normed",
    "detect_injection": _detect_sql("prompt_injection"),
    "detect_jailbreak": _detect_sql("jailbreak"),
    "detect_toxic": _detect_sql("toxic_content"),
    "mask_pii": MASK_PII_SQL,
    "guard_decision": GUARD_SQL,
    "guard_decision_ml": GUARD_ML_SQL,
    "action_counts": ACTION_COUNTS_SQL,
    "ml_verdict": ML_VERDICT_SQL,
    "ml_verdict_multiclass": MULTICLASS_SQL,
    "turn_risk": TURN_RISK_SQL,
    "guard_response": GUARD_RESPONSE_SQL,
    "validate_requests": VALIDATE_SQL,
    "user_turns": USER_TURNS_SQL,
    "outbound_messages": OUTBOUND_SQL,
    "split_sentences": SENTENCES_SQL,
    "token_windows": TOKEN_WINDOWS_SQL,
    "perturb": PERTURB_SQL,
    "calibrate": CALIBRATE_SQL,
}
