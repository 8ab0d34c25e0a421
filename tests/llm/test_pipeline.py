"""The pipeline: each stage against a plain version on its own input."""

import re
import uuid
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute
from tests.llm.test_rows import words
from wardline.llm import mixing
from wardline.llm.packing import CAPACITY, power_below
from wardline.llm.tokens import load

KIND = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, gone_id long"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def tables(spark, folder):
    """90 documents: clean ones, toxic ones that share words of their own, exact and near copies, mails, nulls, repeated rows."""
    rows = []
    for i in range(40):
        rows.append((i, words(i, 90)))
        rows.append((100 + i, " ".join(f"grimbad{(i * 7 + k) % 9} snarl{(i + k) % 7}" for k in range(45)) + f" end{i}"))
    rows += [(50, words(3, 90)), (51, words(4, 90) + " extra"), (52, words(60, 90) + " Write to eva.lind@example.org."),
             (53, None), (54, ""), (55, words(61, 5000)), (55, words(61, 5000)), (56, "!"), (None, words(62, 50))]
    full = [(d, t, "en", None if d is None else f"s{d % 3}", len(t or ""), "x", 7) for d, t in rows]
    spark.createDataFrame(full, KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d >= 100)) for d, _ in rows if d is not None and d % 2 == 0 and d not in (54, 56)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {d for d, t in rows if d is not None and d < 50}


def test_stages(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    clean = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{len(seen)}")
        made = spark.read.parquet(f"{folder}/{len(seen)}")
        if name != "packing":
            assert made.columns == docs.columns, name
        seen.append(made)
        docs = made
    polite, single, private, mixed, packed = seen

    ids = {r["doc_id"] for r in polite.collect()}
    assert not {d for d in ids if d is not None and d >= 100} and len(clean - ids) <= 2 and None in ids

    pairs = [(r["doc_id"], r["text"]) for r in polite.collect()]
    least = brute(pairs)
    expected = {(d, t) for d, t in pairs if d is None or not t or least[d, t] == d}
    assert Counter((r["doc_id"], r["text"]) for r in single.collect()) == Counter(expected)

    before = {(r["doc_id"], r["a.b"], r["gone_id"]): r["text"] for r in single.collect()}
    after = {(r["doc_id"], r["a.b"], r["gone_id"]): r for r in private.collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert (r["text"] is None) == (before[k] is None) and not EMAIL.search(r["text"] or "")
        assert r["n_chars"] == len(r["text"] or "")

    plan = mixing.mix(private).collect()
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["mix_copies"] for r in plan if r["mix_copies"]})
    for source in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == source]
        taken = sum(r["mix_size"] * r["mix_copies"] for r in mine)
        assert abs(taken - mine[0]["mix_target"]) <= 2 * max(r["mix_size"] for r in mine)

    encoder = load(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter(tuple(encoder.encode(r["text"] or "", add_special_tokens=False).ids) + (2,) for r in mixed.collect())
    sequences, whole = {}, {}
    for r in packed.orderBy("sequence_id", "offset").collect():
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in rows:
            assert r["offset"] == at and len(r["ids"]) == r["length"]
            at += r["length"]
        assert at == CAPACITY or at == power_below(at) < CAPACITY
    assert sum(len(r["ids"]) for rows in sequences.values() for r in rows) == sum(len(t) * n for t, n in wanted.items())
    for rows in sequences.values():
        for r in rows:
            whole.setdefault(r["doc_id"], Counter())[r["start"], tuple(r["ids"])] += 1
    for r in mixed.select("doc_id", "text").distinct().collect():
        ids = encoder.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        for (start, piece), _ in whole[r["doc_id"]].items():
            assert tuple(ids[start:start + len(piece)]) == piece


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame([], KIND).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
