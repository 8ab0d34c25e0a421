"""Near copies against all pairs, and ids that stand for more than one text."""

import numpy as np

from wardline.llm import jaccard_join
from tests.llm.test_rows import words

KIND = "doc_id long, text string"


def brute(rows, threshold=0.8):
    """``{(id, text): smallest id that links reach}``, over all pairs of texts."""
    rows = sorted({r for r in rows if r[0] is not None and r[1]})
    sets = [set(jaccard_join.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(r[0], least.get(root[i], r[0]))
    return {r: least[root[i]] for i, r in enumerate(rows)}


def test_an_id_with_a_unique_text_and_a_copy(spark):
    unique, near_unique, copied, other = words(1, 80), words(5, 80), words(2, 80), words(3, 80)
    rows = [(2, copied), (5, unique), (5, copied), (6, near_unique), (6, copied + " more"), (7, other), (7, other), (8, other)]
    made = jaccard_join.deduplicate(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, made)) == sorted([(2, copied), (5, unique), (6, near_unique), (7, other)])


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = [words(100 + i, 60) for i in range(30)]
    rows = []
    for i in range(120):
        t = texts[rng.integers(30)].split()
        for k in rng.integers(0, len(t), rng.integers(0, 3)):
            t[k] = "changed"
        rows.append((int(rng.integers(80)), " ".join(t)))
    docs = spark.createDataFrame(rows, KIND)
    expected = brute(rows)
    made = jaccard_join._similar(docs, "doc_id", "text", 5, 0.8, 0.98, 200, 4).join(
        docs.selectExpr("doc_id", "xxhash64(text) as tie", "text").distinct(), ["doc_id", "tie"]).collect()
    assert len(made) == len(rows) and {(r.doc_id, r.text): r.class_id for r in made} == expected
    kept = {tuple(r) for r in jaccard_join.deduplicate(docs).collect()}
    assert kept == {r for r, name in expected.items() if r[0] == name}


def test_cells_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """F3. A cell holds up to two blocks of texts, so few of them make a batch; afterwards the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = spark.conf.get(name), [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: seen.append((df.columns, spark.conf.get(name))) or real(df))
    text = words(1, 80)
    rows = [(i, text + " more" * (i % 3)) for i in range(6)] + [(9, words(2, 80))]
    made = {r.doc_id: r.class_id for r in jaccard_join.similar_texts(spark.createDataFrame(rows, KIND)).collect()}
    assert made == {**{i: 0 for i in range(6)}, 9: 9} and spark.conf.get(name) == before
    small = [columns for columns, size in seen if int(size) <= jaccard_join.CELLS]
    assert ["half", "a", "b"] in small and ["node", "links", "low"] in small
