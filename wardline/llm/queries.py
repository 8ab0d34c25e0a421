"""Registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ann(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.nn_descent import nearest

    return nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.warc import archive_pages

    return archive_pages(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN last END AS refers_to
FROM m"""


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm import sanitise as S

    rows = S.sanitise(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("san_spans", lambda s: s["kind"].isin(*S.PATTERNS))
    return rows.select(
        "doc_id", *[F.size(f"san_{k}").cast("long").alias(f"n_{k}") for k in S.PATTERNS],
        F.sha2(S.joined(base), 256).alias("base_sha256"), S.joined(F.col("san_spans")).alias("spans"))


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.secret_scans import scan

    return scan(table(spark, sf, "documents")).select(
        "doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op5_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b
      WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN k ON c.vec_id = k.a"""


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from wardline.llm.packing import pack_documents, sign_ids

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf, "documents"), tokenizer, quiet=sign_ids(tokenizer))


def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.jaccard_join import similar_texts

    return similar_texts(table(spark, sf, "documents"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.toxicity import held_out, score

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


def op8_chat(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm import chat

    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    # The two extra rows come from the table's schema, not from its rows: conversation -1 exists for an empty table too.
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok.alias("text"))
    made = chat.format_branches(chat.chain(turns.unionByName(extra)))
    parsed, masked = chat.parse(F.col("formatted")), chat.masked_texts(F.col("formatted"), F.col("loss"))
    read = made.select("tree", "formatted", parsed.alias("turns"), F.array_join(masked, "").alias("trained"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + 1 AS plain,
        len(regexp_extract_all(role || text, '[~<\[]')) + len(regexp_extract_all(role, '\n')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(3 + plain + escaped + 4 + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.mixing import mix

    mixed = mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


# Twin of ``mixing.mix`` at every size: ``mixing.CELL_ROWS`` cuts tasks along this order.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
c AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 4) AS cls FROM d),
s AS (SELECT k, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM c GROUP BY k),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER o AS place,
             coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
      FROM s WINDOW o AS (ORDER BY source_size / w::DOUBLE, k)),
u AS (SELECT *, (total - (2 * below)::DOUBLE) / w_left::DOUBLE AS unit FROM f),
o AS (SELECT unit FROM u WHERE unit * w <= 2 * source_size ORDER BY place LIMIT 1),
t AS (SELECT k, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT unit FROM o) * w, 2.0::DOUBLE * source_size)) AS target,
             ('0x' || substr(md5('mix|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM u),
g AS (SELECT c.*, source_size, target, off, min(size) OVER (PARTITION BY k, cls) * 50 > source_size AS large
      FROM c JOIN t USING (k)),
p AS (SELECT *, row_number() OVER (PARTITION BY k, large ORDER BY cls, size, h, doc_id) AS place,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS whole FROM g),
b AS (SELECT k, sum((floor(whole * place + off) - floor(whole * (place - 1) + off)) * size) AS taken FROM p WHERE large GROUP BY k),
r AS (SELECT k, sum(size) AS rest FROM p WHERE NOT large GROUP BY k),
q AS (SELECT p.*, CASE WHEN large THEN whole WHEN coalesce(rest, 0) > 0
        THEN greatest(0.0::DOUBLE, least(2.0::DOUBLE, (target - coalesce(taken, 0)) / rest::DOUBLE)) ELSE 0.0::DOUBLE END AS ratio
      FROM p LEFT JOIN b USING (k) LEFT JOIN r USING (k))
SELECT doc_id, size, source_size, target,
       ((floor(ratio * place + off) - floor(ratio * (place - 1) + off)) * size)::BIGINT AS taken FROM q"""


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.cross_parsing import held_out, identify

    return identify(table(spark, sf, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("xp_lang").alias("lang_pred"), F.col("xp_score").alias("score"))


def op12_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm import turn_repair

    broken = turn_repair.damage(table(spark, sf, "conversations"))
    return turn_repair.report(broken, present=F.col("present")).withColumnRenamed("conv", "conv_id")


# CRC-32 byte by byte, then all ways to edit row after row; of each (row, grammar state) only the least (cost, audit) goes on.
OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), i) AS v
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda j: ord(name[j])::BIGINT),
                                  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM k, tab),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM e),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM r),
c AS (SELECT *, final = '' AS blank, final <> '' AND again AS dup, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS short,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM a),
ins AS (SELECT * FROM (VALUES (0, '', 0, []::VARCHAR[]), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']),
        (1, 'II', 3, ['user:', 'assistant:']), (2, '', 2, []), (2, 'I', 3, ['assistant:']), (3, '', 3, []), (3, 'I', 2, ['user:'])) t(q, more, q2, added)),
mv AS (SELECT * FROM (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2),
        (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', 'user', 2), (1, 'R', 'user', 2), (2, 'R', 'assistant', 3), (3, 'R', 'user', 2)) t(q, edit, what, q2)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, q2, {'cost': 3 * length(more), 'audit': more, 'rows': added} FROM ids, ins WHERE q = 0
  UNION ALL
  SELECT conv_id, i, q2, min(best) FROM (
    SELECT p.conv_id, c.i, ins.q2, {
      'cost': p.best.cost + 3 * length(more) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND short THEN 3 ELSE 0 END,
      'audit': p.best.audit || edit || more,
      'rows': p.best.rows || CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [role || ':' || text] ELSE [what || ':' || text] END || added} AS best
    FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i + 1 JOIN mv ON mv.q = p.q JOIN ins ON ins.q = mv.q2
    WHERE edit = 'D' OR NOT blank AND NOT dup AND (edit = 'R' OR left(role, 1) = what))
  GROUP BY conv_id, i, q2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (dup) AS duplicate, count(*) FILTER (short) AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id),
g AS (SELECT p.conv_id, min(best) AS best FROM p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id
      WHERE p.i = coalesce(n.n, 0) AND q IN (0, 3) GROUP BY p.conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.rows, chr(10))) AS repaired_sha256
FROM g LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM g.conv_id"""


def op13_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    from wardline.llm.text_tries import audit

    return audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * list_unique(words) < 50 * len(words))::INT
               + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::INT
               + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)::INT) AS good, max(coalesce(toxic = 1, FALSE)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (SELECT part, filter_order, step, mask, n, good, toxic, bits[step] AS bit,
             coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: (mask & bits[i]) > 0)), 6) AS gone FROM h, s),
r AS (SELECT part, bit, coalesce(sum(n) FILTER (gone = step), 0) AS shapley FROM x GROUP BY part, bit)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (gone < step AND (mask & bit) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost,
       any_value(shapley)::BIGINT AS shapley
FROM x JOIN r USING (part, bit) GROUP BY part, filter_order, step"""


QUERIES = {
    "op1_ann": op1_ann, "op2_warc": op2_warc, "op3_pii": op3_pii, "op4_secret_scans": op4_secret_scans, "op5_embedding_near_dedup": op5_embedding_near_dedup, "op6_packing": op6_packing,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op8_chat": op8_chat, "op9_toxicity": op9_toxicity, "op10_mixing": op10_mixing,
    "op11_language_id": op11_language_id, "op12_turn_repair": op12_turn_repair, "op13_filter_audit": op13_filter_audit,
}
ORACLE = {"op2_warc": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL, "op8_chat": OP8_SQL, "op10_mixing": OP10_SQL,
          "op12_turn_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
