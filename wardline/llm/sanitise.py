"""Personal data in whole texts, and terms that give it away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, need

# The four base patterns. A look-behind keeps a match from being tried inside the run where it failed before, \G lets one
# begin where the last one ended, and possessive loops never back off: the matches are those of the plain patterns
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+                               \+[0-9][\x20().0-9-]+[0-9]
# in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without this in a text there is no match; a plain search is cheaper than a pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "omit": ""}
#: A term reveals an entity when their pointwise mutual information is this part of all that the entity says: generalised
#: from TERM_PART on, removed from OMIT_PART on. At least SUPPORT different texts must show the two together.
TERM_PART, OMIT_PART, SUPPORT = 0.8, 0.95, 3
WORD = r"\p{L}{3,}"
#: A table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Revealing terms visit the texts in so many broadcast blocks at most; more of them meet the terms of all texts in a shuffle.
MOST_BLOCKS = 8


def found(text: Column, pattern: Column, values: Column) -> Column:
    """``array<struct<start, end, value>>`` of ``values``, all matches of ``pattern``; code points, end exclusive.

    The pieces between the matches give the places; a text without matches costs no split.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(values)).alias("gap"), values.alias("value"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + F.length(pair["gap"])
        last = first + F.length(pair["value"])
        return F.struct(last.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            first.alias("start"), last.alias("end"), pair["value"].alias("value")))).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(F.size(values) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of a string of digits is right."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        d.try_cast("int") * 2 - F.when(d.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return F.length(digits(value)).between(16, 19) & F.when(F.length(digits(value)).between(16, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``san_text`` (null: empty) and ``san_email .. san_phone``: spans per kind, failing matches dropped."""
    rows = docs.withColumn("san_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    none = F.array().cast("array<string>")
    values = {}
    for kind, pattern in PATTERNS.items():
        matches = F.regexp_extract_all("san_text", F.lit(pattern), F.lit(0))
        able = F.contains("san_text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("san_text").rlike("[0-9][ -]?[0-9]")
        values[f"san_v_{kind}"] = F.when(able, matches).otherwise(none)
    rows = rows.withColumns(values)
    checks = {k: (lambda kind: lambda s: _holds(kind, s["value"]))(k) for k in PATTERNS}
    rows = rows.withColumns({f"san_{k}": F.filter(
        found(F.col("san_text"), F.lit(p), F.col(f"san_v_{k}")), checks[k]) for k, p in PATTERNS.items()})
    return rows.drop(*values)


def _labelled(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def all_base() -> Column:
    """All base spans by kind, then start: ``array<struct<kind, start, end, value>>``."""
    return F.concat(*[F.transform(f"san_{k}", _labelled(k)) for k in PATTERNS])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    """The distinct terms of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def entity(span: Column) -> Column:
    """The protected value behind a span: the same whatever its spelling."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"])))


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str, limit: int) -> DataFrame:
    """Broadcast ``right`` if it has at most ``limit`` rows, else shuffle both."""
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


def disclosing_terms(based: DataFrame, term_part: float, support: int, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """``key, terms array<struct<term, part>>`` for each text (``key``: its MD5) that holds a revealing term; None if no term reveals anything.

    Counts are over different whole texts, so copies are no evidence. Information of an entity: -log2 of the part of all texts
    that hold it; a term's share of it: log2 of how much likelier the two meet in a text than by chance, over that
    information. 1 means that the term never occurs without the entity.

    Pruning is exact. A pair in ``support`` texts needs an entity in as many. With the texts that hold such an entity as all
    that is known of a term, its share can only be too high; what still falls below ``term_part`` goes, first by the
    term's count alone (n ** (1 - part) * n_entity ** part at most), then pair by pair. Only terms that are left are
    counted over all texts.
    """
    keyed = based.select(F.md5("san_text").alias("key"), "san_text", *[f"san_{k}" for k in PATTERNS])
    held = cut(keyed.select("key", F.explode(all_base()).alias("span")).select("key", entity(F.col("span")).alias("entity")).distinct())
    known = cut(held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support))
    if not known.limit(1).count():
        return None
    texts = keyed.select("key").distinct().count()
    n = F.lit(float(texts))
    information = -F.log2(F.col("n_entity") / n)

    def part(n_term: str) -> Column:
        mutual = F.log2(n * F.col("both") / (F.col("n_entity") * F.col(n_term)))
        return F.when(information > 0, mutual / information).otherwise(F.lit(0.0))

    telling = cut(held.join(known, "entity"))
    holders = cut(telling.select("key").distinct())
    spoken = cut(sized_join(keyed.select("key", "san_text"), holders, "key", "left_semi", limit).select(
        "key", F.explode(terms_of(F.col("san_text"))).alias("term")).distinct())
    most = F.pow(n, F.lit(1 - term_part)) * F.pow(F.lit(float(known.agg(F.max("n_entity")).first()[0])), F.lit(term_part))
    rare = spoken.groupBy("term").agg(F.count("*").alias("n_spoken")).where(
        (F.col("n_spoken") >= support) & (F.col("n_spoken") <= most * (1 + 1e-9)))
    pairs = spoken.join(rare, "term").join(telling, "key").groupBy("entity", "term").agg(
        F.count("*").alias("both"), F.first("n_entity").alias("n_entity"), F.first("n_spoken").alias("n_spoken"))
    pairs = cut(pairs.where((F.col("both") >= support) & (part("n_spoken") >= term_part)).drop("n_spoken"))
    if not pairs.limit(1).count():
        return None
    # Every term is counted over different texts where these lie, so no (text, term) pair travels: only terms and their counts do.
    counted = keyed.select("key", "san_text").dropDuplicates(["key"]).select(F.explode(terms_of(F.col("san_text"))).alias("term")).groupBy(
        "term").agg(F.count("*").alias("n_term"))
    revealing = cut(pairs.join(counted, "term").withColumn("part", part("n_term")).where(F.col("part") >= term_part)
                    .groupBy("term").agg(F.max("part").alias("part")))
    size = revealing.count()
    if not size:
        return None
    # Now the texts that hold one of these: each block of revealing terms is small enough to visit all texts.
    blocks = -(-size // limit)
    spoken = keyed.select("key", F.explode(terms_of(F.col("san_text"))).alias("term"))
    if blocks <= MOST_BLOCKS:
        own = F.pmod(F.xxhash64("term"), F.lit(blocks))
        hits = reduce(DataFrame.unionByName, [spoken.join(F.broadcast(revealing.where(own == i)), "term") for i in range(blocks)])
    else:
        hits = spoken.join(revealing, "term")
    return hits.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("terms"))


def sanitise(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", term_part: float = TERM_PART, omit_part: float = OMIT_PART,
    support: int = SUPPORT, limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """All columns of ``docs`` and ``san_email, san_ip, san_card, san_phone`` (spans), ``san_spans`` (all spans with their
    kind), ``san_clean`` (the text with its spans masked).

    Base spans are the four patterns' checked matches. Terms that reveal a protected value to anyone who knows the corpus
    are spans of kind ``term`` (replaced by a general mark) or ``omit`` (removed) wherever they stand, unless they touch a base
    span. JVM expressions throughout. A null text is empty, null and repeated ids are rows like others, columns called ``san_*``
    are replaced. Overlapping spans of different kinds are masked together, under the first one's mark.
    """
    need(docs, [id, text])
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("san_")])
    based = with_base(docs, text)
    terms = disclosing_terms(based, term_part, support, limit)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    rows = based.withColumn("san_base", all_base())
    if terms is None:
        rows = rows.withColumn("san_more", empty)
    else:
        terms = cut(terms)
        keyed = rows.withColumn("san_key", F.md5("san_text"))
        terms = terms.select(F.col("key").alias("san_key"), F.col("terms").alias("san_terms"))
        rows = sized_join(keyed, terms, "san_key", "left", limit).drop("san_key")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("san_terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
        rows = rows.withColumn("san_pattern", pattern).withColumn("san_values", F.when(
            F.col("san_terms").isNull(), F.array().cast("array<string>")).otherwise(
            F.regexp_extract_all("san_text", F.col("san_pattern"), F.lit(0))))
        hard = F.transform(F.filter("san_terms", lambda t: t["part"] >= omit_part), lambda t: t["term"])
        spans = found(F.col("san_text"), F.col("san_pattern"), F.col("san_values"))
        kind = lambda s: F.when(F.array_contains(hard, F.lower(s["value"])), "omit").otherwise("term")
        more = F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        clear = F.filter(more, lambda m: ~F.exists("san_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        rows = rows.withColumn("san_more", F.when(F.col("san_terms").isNull(), empty).otherwise(clear))
        rows = rows.drop("san_terms", "san_pattern", "san_values")
    in_order = F.array_sort(F.transform(F.concat("san_base", "san_more"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    mask = lambda kind: F.element_at(F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair]), kind)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("san_text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(
            fresh, F.concat(acc["made"], F.array(gap, mask(s["kind"])))).otherwise(acc["made"]).alias("made"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("made"))
    clean = F.aggregate(in_order, begin, step, lambda acc: F.concat(
        F.array_join(acc["made"], ""), F.substring(F.col("san_text"), acc["at"] + 1, F.length("san_text"))))
    spans = F.concat("san_base", F.array_sort(F.col("san_more"), lambda a, b: F.when(a["kind"] > b["kind"], -1).when(
        a["kind"] < b["kind"], 1).otherwise(a["start"] - b["start"])))
    return rows.withColumn("san_spans", spans).withColumn("san_clean", F.when(
        F.size("san_spans") > 0, clean).otherwise(F.col("san_text"))).drop("san_base", "san_more", "san_text")
