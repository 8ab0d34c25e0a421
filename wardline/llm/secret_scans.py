"""Secret scans: candidates in whole texts, and a random forest that takes the false positives out."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import cut, need

#: A candidate: a whole run of such characters that is long enough.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
#: Characters on either side whose words tell about a candidate.
BEFORE, AFTER = 48, 24
#: Labelled findings that train the forest: so many at most, those with the smallest hashes.
MAX_FINDINGS = 6000
TREES, DEPTH, BINS, SEED = 24, 8, 48, 7
#: A word is known when it stands so often in the corpus.
KNOWN_WORDS, LEAST_LETTERS = 5, 3
THRESHOLD = 0.5
MARK = "\u0001"

# -- fixed values: words beside a candidate, and parts of paths ------------------------------------------
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|credential|api.?key|auth|bearer|private|access.?key|signature)"
HARMLESS_WORDS = r"(?i)(commit|sha|hash|checksum|md5|uuid|guid|digest|revision|version|order|card|invoice|phone|number|serial|etag)"
HARMLESS_PATHS = r"(?i)(test|example|sample|mock|fixture|demo|docs?/)"

FEATURES = ("length", "digits", "upper", "distinct", "changes", "surprise", "coverage", "path", "asks", "harmless", "assigned", "quoted")


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``row, doc_id, path, start, candidate, before, after`` of every candidate in every whole text; ``start`` counts code points.

    Texts are split at the candidates, so a long text is scanned once; only texts that hold one go on. The place of a
    candidate is a running sum over the pieces of its row.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.translate(F.coalesce(F.col(text), F.lit("")), MARK, " ").alias("text")).where(F.col("text").rlike(CANDIDATE))
    pieces = rows.select("row", "doc_id", "path", F.split(
        F.regexp_replace("text", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK).alias("pieces"))
    # Odd pieces (from 0) are candidates; a piece between two goes on with its edges and its length alone.
    each = F.transform("pieces", lambda p, i: F.struct(
        F.length(p).cast("long").alias("size"), F.when(i % 2 == 1, p).alias("candidate"),
        F.when(i % 2 == 1, F.right(F.get("pieces", i - 1), F.lit(BEFORE))).alias("before"),
        F.when(i % 2 == 1, F.left(F.get("pieces", i + 1), F.lit(AFTER))).alias("after")))
    flat = pieces.select("row", "doc_id", "path", F.posexplode(each).alias("at", "piece")).select("row", "doc_id", "path", "at", "piece.*")
    along = Window.partitionBy("row").orderBy("at")
    return flat.withColumn("start", F.sum("size").over(along) - F.col("size")).where("candidate is not null").select(
        "row", "doc_id", "path", "start", "candidate", "before", "after")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{LEAST_LETTERS},}})"), F.lit(1))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``w, count``: every word of every text (3 letters and more, without their case), counted once and kept."""
    return cut(docs.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("w")).where(
        F.length("w") >= LEAST_LETTERS).groupBy("w").count())


def bigrams(words: DataFrame) -> dict[str, float]:
    """Bits that each pair of letters carries in the corpus' words; at most 26 x 26 entries."""
    pairs = words.select("count", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("count").alias("n")).collect()}
    first: dict[str, int] = {}
    for pair, n in found.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    import math

    return {pair: -math.log2(n / first[pair[0]]) for pair, n in found.items()}


def with_features(found: DataFrame, words: DataFrame, bits: dict[str, float]) -> DataFrame:
    """``found`` and ``FEATURES``. ``found``: ``row, path, start, candidate, before, after``.

    Dictionary coverage: the letters of a candidate that lie in words which the corpus uses, as a part of its length. Words and
    fragments are counted before they meet, so a frequent word or a repeated candidate is one row.
    """
    pieces = found.select("candidate").distinct().select("candidate", F.explode(F.array_distinct(_words(F.col("candidate")))).alias("w"))
    wanted = pieces.select("w").distinct()
    known = words.where(F.col("count") >= KNOWN_WORDS).join(wanted, "w", "left_semi").select("w")
    covered = pieces.join(known, "w").groupBy("candidate").agg(F.collect_set("w").alias("known"))
    c, lower, n = F.col("candidate"), F.lower("candidate"), F.length("candidate").cast("double")
    table = F.create_map(*[F.lit(x) for pair in sorted(bits.items()) for x in pair]) if bits else F.create_map(F.lit(""), F.lit(0.0))
    kinds = F.translate(c, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "....." )
    at = F.sequence(F.lit(1), F.length("candidate") - 1)
    changes = F.size(F.filter(F.transform(at, lambda i: F.substr(kinds, i, F.lit(2))), lambda p: F.substr(p, F.lit(1), F.lit(1)) != F.substr(p, F.lit(2), F.lit(1))))
    surprise = F.aggregate(
        F.transform(at, lambda i: F.coalesce(F.element_at(table, F.substr(lower, i, F.lit(2))), F.lit(12.0))), F.lit(0.0), lambda s, x: s + x)
    inside = F.aggregate(F.filter(_words(c), lambda w: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), w)), F.lit(0), lambda s, w: s + F.length(w))
    number = lambda x: x.cast("double")
    return found.join(covered, "candidate", "left").withColumns({
        "length": F.log2(n), "digits": F.length(F.regexp_replace(c, "[^0-9]", "")) / n, "upper": F.length(F.regexp_replace(c, "[^A-Z]", "")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "changes": changes / n, "surprise": surprise / n, "coverage": inside / n,
        "path": number(F.col("path").rlike(HARMLESS_PATHS)), "asks": number(F.col("before").rlike(SECRET_WORDS)),
        "harmless": number(F.col("before").rlike(HARMLESS_WORDS) | F.col("after").rlike(HARMLESS_WORDS)),
        "assigned": number(F.col("before").rlike("[:=]>?[ \"'`]*$")), "quoted": number(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
    }).drop("known")


def made_findings(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = MAX_FINDINGS) -> DataFrame:
    """``path, candidate, before, after, label``: labelled findings made out of a bounded sample of the documents.

    Each sampled text lends its words as neighbours and its hash as randomness: half are secrets (random runs of hex, base 62 or
    base 64 characters behind a word that asks for one, or bare), half are what scanners report falsely (long words and
    names, card and order numbers, checksums and commits named as such, placeholders, paths).
    """
    share = min(1.0, 2 * limit / max(1, docs.count()))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    picked = rows.where(F.pmod(F.shiftright("h", 24), F.lit(1 << 20)) < int(share * (1 << 20))).distinct().orderBy("h").limit(limit)
    a, b = F.sha2("text", 256), F.sha2(F.concat(F.lit("b"), F.col("text")), 256)
    words = F.filter(F.split(F.substring("text", 1, 2000), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    long_word = F.array_join(F.slice(words, (F.pmod("h", F.greatest(F.size(words) - 4, F.lit(1))) + 1).cast("int"), 4), "")
    kind = F.pmod("h", F.lit(12))
    raw = F.base64(F.unhex(F.concat(a, b)))
    plain = F.regexp_replace(raw, "[+/=]", "x")
    ascii_word = F.regexp_replace(long_word, "[^A-Za-z]", "n")
    lead = F.array_join(F.slice(words, 1, 5), " ")
    size = (F.pmod(F.shiftright("h", 8), F.lit(24)) + 20).cast("int")
    asks = F.element_at(F.array(*[F.lit(x) for x in (
        'token = "', "api_key: ", "password='", "secret=", "Authorization: Bearer ", 'access_key = "', "auth: ", "credential ")]), (F.pmod(F.shiftright("h", 16), F.lit(8)) + 1).cast("int"))
    told = F.element_at(F.array(*[F.lit(x) for x in ("commit ", "sha1: ", "checksum ", "md5=", "uuid ", "etag: ", "revision ", "digest ")]),
                        (F.pmod(F.shiftright("h", 16), F.lit(8)) + 1).cast("int"))
    digits = F.rpad(F.regexp_replace(F.concat(a, b), "[a-f]", ""), 40, "7")
    case = lambda *options: F.coalesce(*[F.when(kind == i, o) for i, o in enumerate(options)])
    bare = F.concat(lead, F.lit(" "))
    return picked.select(
        F.when(kind == 11, "docs/example").otherwise("src/main").alias("path"),
        case(F.left(a, F.lit(40)), F.left(a, F.lit(32)), F.left(plain, size), F.left(raw, size), F.left(plain, F.lit(40)), F.left(a, size),
             F.left(a, F.lit(40)), F.rpad(F.left(ascii_word, size), 16, "an"), F.left(digits, F.lit(16)),
             F.concat(F.lit("usr/lib/"), F.rpad(F.left(ascii_word, F.lit(30)), 12, "en")), F.left(digits, size),
             F.concat(F.lit("your-example-"), F.left(ascii_word, F.lit(12)), F.lit("-here"))).alias("candidate"),
        case(*[F.concat(bare, asks)] * 4, bare, F.concat(bare, asks), F.concat(bare, told), bare, bare, bare, F.concat(bare, told), F.concat(bare, asks)).alias("before"),
        F.when(asks.endswith('"') & (kind < 4), F.concat(F.lit('" '), F.element_at(words, 1))).otherwise(F.concat(F.lit(" "), F.coalesce(F.get(words, F.lit(6)), F.lit("")))).alias("after"),
        (kind < 6).cast("double").alias("label")).where(F.col("candidate").rlike("^[A-Za-z0-9+/_=-]{16,}$"))


def train(findings: DataFrame, words: DataFrame, bits: dict[str, float]) -> RandomForestClassificationModel:
    """The forest from labelled findings (``path, candidate, before, after, label``), about ``MAX_FINDINGS`` of them."""
    rows = cut(with_features(findings.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("path", "before", "after")}), words, bits))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED)
    return forest.fit(_vectors(rows).select("features", "label").orderBy("features").coalesce(1))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows)


def scan(
    docs: DataFrame, findings: DataFrame | None = None, *, id: str = "doc_id", text: str = "text", path: str = "source", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, candidate, score, is_secret``.

    ``findings``: labelled findings, by default ``made_findings``. A candidate is a whole run of 16 or more characters of keys;
    its score is the share of the forest's votes that it is a secret. Features: length, character transitions (changes of
    kind, bits of letter pairs, kinds and spread of characters), dictionary coverage, path, words on either side.

    A null or empty text holds no candidate, a null path is empty. Rows with null or repeated ids are scanned like others,
    repeated rows give repeated findings. Without labelled findings of both kinds (an empty table) every score is 0.
    Everything runs in the JVM; ``docs`` is read for its words, for the candidates and, without ``findings``, for the sample.
    """
    need(docs, [id, text, path])
    found = cut(candidates(docs, id, text, path))
    words = word_counts(docs, text)
    bits = bigrams(words)
    labelled = cut((findings if findings is not None else made_findings(docs, id, text)).select(
        "path", "candidate", "before", "after", F.col("label").cast("double").alias("label")).where("label is not null and candidate is not null"))
    out = ["doc_id", "start", F.length("candidate").alias("length"), "candidate"]
    if labelled.select("label").distinct().count() < 2:
        return found.select(*out, F.lit(0.0).alias("score"), F.lit(0).alias("is_secret"))
    model = train(labelled, words, bits)
    scored = model.transform(_vectors(with_features(found.withColumnRenamed("start", "_start"), words, bits)))
    share = vector_to_array("probability")[1]
    return scored.select("doc_id", F.col("_start").alias("start"), *out[2:], share.alias("score"), (share >= threshold).cast("int").alias("is_secret"))
