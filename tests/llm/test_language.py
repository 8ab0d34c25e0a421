"""Language by cross-parsing: phrases against a plain parse, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import cross_parsing as X

DOCS = "doc_id long, text string, lang string, source string, xp_lang string, block string, h long"


def plain_phrases(text, blocks):
    """Greedy longest matches by substring search, in windows."""
    n = 0
    for at in range(0, len(text), X.WINDOW):
        part, i = text[at:at + X.WINDOW], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and any(part[i:i + k + 1] in b for b in blocks):
                k += 1
            i, n = i + k, n + 1
    return n


def test_phrases_equal_a_plain_parse():
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    blocks = {"xx": [make("abc ", 60) for _ in range(4)], "yy": [make("abd ", 80) for _ in range(3)]}
    own = [ord(c) for c in "abcd"]
    table = X.symbol_table(own)
    clean = lambda t: " ".join(t.split(" ")) if "  " not in t else clean(t.replace("  ", " "))
    model = X.joined(list(blocks), own, [X.automaton(b, table) for b in blocks.values()])
    texts = [make("abcd ", rng.randrange(0, 1300)) for _ in range(60)] + ["", "a", "zq", "  "]
    total, size, letters = X.parse(model, table, texts)
    for i, t in enumerate(texts):
        t = clean(t)
        assert size[i] == len(t) and letters[i] == len(t.replace(" ", ""))
        assert [plain_phrases(t, [clean(b) for b in bs]) for bs in blocks.values()] == list(total[:, i])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = X.identify(docs).where(X.held_out(F.col("doc_id"))).select("lang", "xp_lang", "xp_score").toPandas()
    assert len(rows) > 250 and (rows.lang == rows.xp_lang).mean() >= 0.98 and rows.xp_score.between(0, 1).all()


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    rows = [(i, text("abcde", 150), "aa") for i in range(9)] + [(20 + i, text("vwxyz", 150), "zz") for i in range(9)]
    rows += [(40, None, "aa"), (41, "", "zz"), (42, "12 ?!", "aa"), (None, text("abcde", 40), None), (None, None, None),
             (43, text("vwxyz", 60_000), "aa"), (1, text("vwxyz", 30), "zz"), (1, text("vwxyz", 30), "zz"), (44, "\U0001F600 éß", None)]
    return spark.createDataFrame([(*r, "s", "own", "own", 5) for r in rows], DOCS)


def test_odd_rows(odd):
    made = X.identify(odd, sample_chars=4000)
    assert made.columns == [*[c for c in odd.columns if c != "xp_lang"], "xp_lang", "xp_score"] and made.count() == odd.count()
    rows = made.collect()
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 1)}
    assert all(by[i].xp_lang == "aa" for i in range(2, 9)) and all(by[20 + i].xp_lang == "zz" for i in range(9))
    assert by[43].xp_lang == "zz" and all(by[i].xp_lang == X.UNKNOWN and by[i].xp_score == 0 for i in (40, 41, 42))
    assert sorted(r.xp_lang for r in rows if r.doc_id is None) == ["aa", X.UNKNOWN]
    assert sorted(map(str, rows)) == sorted(map(str, X.identify(odd.repartition(5), sample_chars=4000).collect()))
    assert all(r.block == "own" and r.h == 5 for r in rows)


def test_labels_teach_only_where_not_held_out(odd):
    wrong = odd.withColumn("lang", F.when(X.held_out(F.col("doc_id")), F.lit("qq")).otherwise(F.col("lang")))
    key = lambda d: sorted(map(str, X.identify(d, sample_chars=4000).select("doc_id", "xp_lang", "xp_score").collect()))
    assert key(odd) == key(wrong)


def test_nothing_to_learn(spark, odd):
    none = odd.where("false")
    assert X.identify(none).count() == 0
    unlabelled = X.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.xp_lang for r in unlabelled} == {X.UNKNOWN}
    one = X.identify(odd.where("lang = 'aa'")).where("doc_id = 2").first()
    assert one.xp_lang == "aa" and one.xp_score == 1.0
