"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import chat, embed_dedup, jaccard_join, mixing, nn_descent, packing, sanitise, toxicity, warc

DOCS = "doc_id long, text string, source string, lang string, n_chars long, key int, size int, place int, first int, rows int, node int"
LABELS = "doc_id long, quality int, toxic int"
MORE = (1, 2, 3, 4, 5, 6)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long_ = words(9, 30_000)
    rows = [
        (1, words(1, 80), "a", "en"), (2, words(1, 80), "a", "en"), (3, words(1, 80) + " more", None, None), (4, None, "b", "en"),
        (5, "", "b", "en"), (6, " \t\n", "b", "en"), (None, words(1, 80), "a", "en"), (None, None, None, None), (7, long_, "c", "en"),
        (8, long_ + " end", "c", "en"), (1, words(1, 80), "a", "en"), (1, words(2, 60), "a", "en"), (9, "two words", "b", "en"),
        (10, "two words", "b", "en"), (11, "mail a@b.example now", "b", "en"), (12, "\U0001F600 x y z w v", "b", "en"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *MORE) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (9, 1, 0), (11, 1, 1), (11, 1, 1)], LABELS)


def test_mix_rows(docs, none):
    made = mixing.mix(docs)
    assert made.columns[:len(docs.columns)] == docs.columns and made.count() == docs.count()
    assert made.where("mix_copies > 2 or mix_copies < 0").count() == 0
    sizes = {r.doc_id: r.mix_size for r in made.where("doc_id > 3").collect()}
    assert sizes[4] == sizes[5] == sizes[6] == 0 and sizes[8] == 30_001
    assert made.where("place = 3 and first = 4 and size = 2").count() == docs.count()
    assert mixing.mix(none).count() == 0 and mixing.emit(mixing.mix(none)).columns == docs.columns
    again = sorted(map(str, mixing.mix(docs.repartition(5)).select("doc_id", "mix_copies").collect()))
    assert again == sorted(map(str, made.select("doc_id", "mix_copies").collect()))


def test_similar_rows(docs, none):
    made = jaccard_join.similar_texts(docs).collect()
    assert len(made) == docs.count()
    by = {r.doc_id: r for r in made if r.doc_id not in (None, 1)}
    assert by[2].class_id == 1 and by[3].class_id == 1 and by[8].class_id == 7 and by[10].class_id == 9
    assert by[8].n_links == 1 and by[10].n_links == 1 and by[4].n_links == by[5].n_links == 0 and by[5].kept
    assert all(r.kept and r.n_links == 0 for r in made if r.doc_id is None)
    kept = jaccard_join.deduplicate(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 1, 4, 5, 6, 7, 9, 11, 12]
    assert jaccard_join.similar_texts(none).count() == 0 and jaccard_join.deduplicate(none).count() == 0


def test_sanitise_rows(docs, none):
    made = sanitise.sanitise(docs)
    assert made.columns[:len(docs.columns)] == docs.columns and made.count() == docs.count()
    by = {r.doc_id: r for r in made.where("doc_id > 3").collect()}
    assert by[11].san_clean == "mail [EMAIL] now" and by[4].san_clean == "" and by[5].san_spans == []
    assert made.where("key = 1").count() == docs.count() and sanitise.sanitise(none).count() == 0


def test_toxicity_rows(spark, docs, none, labels):
    made = toxicity.score(docs, labels)
    assert made.columns == docs.columns + ["tox_score", "tox_predicted"] and made.count() == docs.count()
    assert made.where("tox_score is null or tox_score < 0 or tox_score > 1 or (tox_score >= 0.5) != (tox_predicted = 1)").count() == 0
    assert toxicity.score(none, labels).count() == 0
    unknown = toxicity.score(docs, spark.createDataFrame([], LABELS))
    assert unknown.where("tox_score != 0").count() == 0 and unknown.count() == docs.count()


def test_packing_rows(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.pack_documents(docs, path).collect()
    assert sum(r.start == 0 for r in made) == docs.count()
    assert [r.doc_tokens for r in made if r.doc_id in (4, 5, 6)] == [1, 1, 1]
    assert packing.pack_documents(none, path).count() == 0


def test_chat_rows(spark):
    kind = "conv_id long, turn long, role string, text string, position int, branch int, tree int"
    rows = [(1, 0, "user", "a<b[c~d"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, None, "</s>"), (2, 0, "assistant", "é~1\U0001F600"),
            (2, 0, "assistant", "é~1\U0001F600"), (3, 5, "assistant", ""), (4, 0, "sys\ntem", "[INST] "), (5, 0, "user", "y" * 100_000)]
    made = chat.format_branches(chat.chain(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], kind)))
    read = made.select("tree", chat.parse(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    turns = {r.tree: [(t.role, t.text) for t in r.turns] for r in read}
    assert turns[1] == [("user", "a<b[c~d"), ("assistant", "")] and turns[None] == [("user", "x")]
    assert turns[2] == [("", "</s>"), ("assistant", "é~1\U0001F600"), ("assistant", "é~1\U0001F600")]
    assert turns[4] == [("sys\ntem", "[INST] ")] and turns[5] == [("user", "y" * 100_000)]
    assert {r.tree: r.loss for r in read}[2] == ["é~1\U0001F600"] * 2
    assert chat.format_branches(chat.chain(spark.createDataFrame([], kind))).count() == 0


def test_warc_rows(spark):
    kind = "page_id long, url string, html string, payload int, role int"
    body = "é" * 600
    rows = [(1, "http://a", body), (2, None, body), (3, "x y\r\nz", body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (None, "u", body), (3, "x", body), (8, "u", "z" * 3_000_000)]
    made = warc.archive_pages(spark.createDataFrame([(*r, 1, 2) for r in rows], kind), payloads=True).collect()
    assert len(made) == len(rows) and all(r.digest_ok for r in made)
    by = {r.page_id: r for r in made}
    sha = hashlib.sha1(body.encode()).hexdigest()
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes, by[1].payload_sha1) == ("revisit", 3, 1200, sha)
    assert by[3].record_type == "response" and by[None].record_type == "response" and by[6].record_type == by[7].record_type == "response"
    assert bytes(by[8].payload) == b"z" * 3_000_000 and by[4].payload_bytes == 0
    assert warc.archive_pages(spark.createDataFrame([], kind)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rank int, node int, dim int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7),
             (204, []), (None, rows[0][1]), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] + [0.0] * 7), (0, rows[0][1]), (208, [3 * x for x in rows[0][1]])]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)


def test_embedding_rows(spark, vectors):
    made = embed_dedup.near_duplicates(vectors).collect()
    assert len(made) == vectors.count()
    by = {r.vec_id: r for r in made}
    assert by[100].component_id == 0 and by[100].n_links == 32 and not by[100].kept and by[206].component_id == 205
    assert by[208].component_id == 0 and by[200].n_links == by[201].n_links == by[204].n_links == by[None].n_links == 0 and by[203].kept
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_nearest_rows(spark, vectors):
    made = nn_descent.nearest(vectors, F.col("id") % 20 == 0).collect()
    by = {}
    for r in made:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {0, 20, 40, 100, 120}
    top = [r.vec_id for r in sorted(by[100], key=lambda r: r.rank)]
    assert top[0] == 208 and top[1:4] == [0, 101, 102] and 100 not in top and len(top) == 20
    assert nn_descent.nearest(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0).count() == 0


def test_branches_of_a_tree(spark):
    kind = "tree int, node string, parent string, score double"
    rows = [(1, "r", None, 0.0), (1, "a", "r", 1.0), (1, "b", "r", 0.2), (1, "a1", "a", 0.0), (1, "a2", "a", 0.9), (1, "b1", "b", None),
            (2, "x", "gone", 0.5), (3, "c", "d", 1.0), (3, "d", "c", 1.0)]
    made = chat.branches(spark.createDataFrame(rows, kind), top=2).collect()
    paths = {}
    for r in sorted(made, key=lambda r: r.position):
        paths.setdefault((r.tree, r.branch), []).append(r.node)
    assert paths == {(1, 1): ["r", "a", "a2"], (1, 2): ["r", "a", "a1"], (2, 1): ["x"]}
