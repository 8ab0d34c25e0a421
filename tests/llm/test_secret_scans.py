"""Candidates against a plain scan, secrets of documents the forest never saw labelled, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import secret_scans as S

DOCS = "doc_id long, text string, source string, lang string, row long, candidate string, label double, features string"


def plain(rows):
    found = []
    for doc, text, path in rows:
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", text or ""):
            found.append((doc, path or "", m.start(), m.group(), (text[:m.start()])[-10:], text[m.end():][:10]))
    return sorted(found, key=str)


def test_candidates_equal_a_plain_scan(spark):
    rng = random.Random(1)
    piece = lambda: "".join(rng.choice("aB3-=/ .é\U0001F600\n") if rng.random() < 0.2 else rng.choice("abcXYZ019_+") for _ in range(rng.randrange(1, 60)))
    rows = [(i, " ".join(piece() for _ in range(rng.randrange(0, 12))), rng.choice(["a", None])) for i in range(200)]
    rows += [(None, "token=" + "a1" * 20, "x"), (1, None, "x"), (2, "", "x"), (3, "b2" * 40_000 + " " + "c3" * 30, "x"), (3, "c3" * 10, "x"), (3, "c3" * 10, "x")]
    made = S.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(((r.doc_id, r.path, r.start, r.candidate) for r in made), key=str) == sorted((f[:4] for f in plain(rows)), key=str)
    known = {(f[0], f[2], f[3]): f[4:] for f in plain([r for r in rows if r[0] not in (3, None)])}
    for r in made:
        if (r.doc_id, r.start, r.candidate) in known and r.doc_id != 1:
            before, after = known[r.doc_id, r.start, r.candidate]
            # an edge ends where a neighbouring candidate begins
            assert before.endswith(r.before[-10:]) and after.startswith(r.after[:10])


@pytest.fixture(scope="module")
def scanned(spark):
    return S.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()


def test_planted_secrets_are_found_and_other_candidates_left_alone(scanned):
    planted = scanned.candidate.str.fullmatch("[0-9a-f]{40}")
    assert planted.sum() >= 10 and (scanned[planted].is_secret == 1).all()
    rest = scanned[~planted & ~scanned.candidate.str.contains("[0-9].*[A-Za-z].*[0-9]")]
    assert len(rest) > 100 and (rest.is_secret == 1).mean() < 0.02 and scanned.score.between(0, 1).all()


def test_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = S.made_findings(docs, limit=800)
    split = F.crc32("candidate") % 4 == 0
    words = S.word_counts(docs)
    bits = S.bigrams(words)
    model = S.train(made.where(~split), words, bits)
    held = made.where(split)
    scored = model.transform(S._vectors(S.with_features(held, words, bits))).select("label", "prediction").collect()
    assert len(scored) > 100 and sum(r.label == r.prediction for r in scored) / len(scored) > 0.93


def test_reruns_agree(spark, scanned):
    again = S.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)).toPandas()
    key = lambda f: sorted(zip(f.doc_id, f.start, f.candidate, f.is_secret, f.score.round(9)))
    assert key(scanned) == key(again)


def test_odd_rows(spark):
    rows = [(1, 'x token = "' + "9f3a" * 10 + '" y', "a"), (None, 'x token = "' + "9f3a" * 10 + '" y', None), (1, 'x token = "' + "9f3a" * 10 + '" y', "a"), (2, None, "a"),
            (3, "", None), (4, "word " * 50, "a"), (5, "\x01" * 5 + "q7" * 10, "a")]
    docs = spark.createDataFrame([(*r, "en", 7, "own", 0.5, "own") for r in rows], DOCS)
    made = S.scan(docs).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in made) == [("1", 11, 40), ("1", 11, 40), ("5", 5, 20), ("None", 11, 40)]
    assert S.scan(docs.where("false")).count() == 0
    one = spark.createDataFrame([("p", "a1" * 20, "key ", "", 1.0)], "path string, candidate string, before string, after string, label double")
    assert {(r.score, r.is_secret) for r in S.scan(docs, one).collect()} == {(0.0, 0)}
