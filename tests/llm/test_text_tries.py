"""Tries, cut points and the filter audit against plain versions."""

import random
from itertools import permutations

import pytest

from wardline.llm import text_tries as A

DOCS = "doc_id long, text string, source string, mask int, n long, part string, cell int, good long"
LABELS = "doc_id long, quality int, toxic int, source string"


def plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    counts = {}
    for d, text, part in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            any(c in "#$%&*|" for c in text), d is not None and first[text] < d)) if bad}
        for order in map("".join, permutations("ABCDE")):
            at = next((i for i, f in enumerate(order) if f in fails), 9)
            for i, f in enumerate(order):
                held = counts.setdefault((part or "", order, i + 1), [0] * 6)
                for k, yes in enumerate((at > i, at == i, f in fails and at < i, fails == {f}, at == i and d in good, at == i and d in toxic)):
                    held[k] += yes
    shapley = {}
    for (part, order, step), v in counts.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in counts.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["alpha", "Beta", "g#", "delta", "EPS", "é\U0001F600", "x|y"]
    text = lambda n, k: " ".join(rng.choice(words[:k]) + (str(rng.randrange(400)) if k > 3 else "") for _ in range(n))
    head = "license line " * 600
    made = [(i, text(rng.choice([0, 3, 190, 260]), rng.choice([1, 2, 4, 7])), rng.choice(["a", "b", None])) for i in range(60)]
    made += [(100 + i, "the same text " * 80, "a") for i in range(50)] + [(90, "the same text " * 80, "b"), (90, "the same text " * 80, "a")]
    made += [(200 + i, head + str(i // 2), "b") for i in range(60)] + [(300, head, None), (301, head[:-1], "a"), (302, head[:5], "a")]
    made += [(None, "the same text " * 80, "a"), (None, None, None), (400, None, "a"), (401, "", "b"), (402, " \t\n", "b"), (403, "w " * 200_000, "b")]
    return made


@pytest.fixture(scope="module")
def labels():
    return [(i, i % 2, i % 5 == 0) for i in range(0, 260, 3)] + [(90, 1, 1), (90, 0, 0), (None, 1, 1), (6, None, None), (9999, 1, 1)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "own", 3, 4) for r in rows], DOCS)
    return docs, spark.createDataFrame([(d, q, None if t is None else int(t), "own") for d, q, t in labels], LABELS)


def test_audit_equals_a_plain_version(spark, rows, labels):
    docs, known = frames(spark, rows, labels)
    for cell_bytes in (A.CELL_BYTES, 60_000):
        made = A.audit(docs, known, cell_bytes=cell_bytes)
        assert made.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, made.collect())) == plain(rows, labels)
    again = sorted(map(tuple, A.audit(docs.repartition(7), known).collect()))
    assert again == plain(rows, labels)


def test_small_blocks_give_the_same_masks(spark, rows, labels, monkeypatch):
    docs, _ = frames(spark, rows, labels)
    key = lambda d: sorted(map(str, d.groupBy("doc_id", "part", "mask").sum("n").collect()))
    whole = key(A.masks(docs))
    monkeypatch.setattr(A, "BLOCK_BYTES", 2000)
    assert key(A.masks(docs, cell_bytes=20_000)) == whole


def test_empty_tables(spark, rows, labels):
    docs, known = frames(spark, rows, labels)
    assert A.audit(docs.where("false"), known).count() == 0
    without = A.audit(docs, known.where("false"))
    assert without.where("good_lost + toxic_lost > 0").count() == 0 and without.count() == 3 * 600


def test_cut_points_hold_the_weight(spark):
    rng = random.Random(4)
    head = b"common head " * 900
    texts = [head + bytes(rng.choices(b"abcdef", k=300)) for _ in range(400)] + [bytes(rng.choices(b"abc", k=100)) for _ in range(400)]
    texts += [b"one text"] * 3000 + [head, head[:-1], b""]
    cuts = A.cut_points(spark.createDataFrame([(t,) for t in texts], "t binary"), 200_000)
    assert cuts == sorted(cuts) and len(cuts) > 10
    from bisect import bisect_right

    cells = {}
    for t in set(texts):
        c = bisect_right(cuts, t)
        cells[c] = cells.get(c, 0) + len(t)
    assert max(cells.values()) < 500_000


def test_trie_holds_every_text_once():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))).encode() for _ in range(2000)] + [b"\xc3\xa9" * 50_000]
    trie = A.Trie()
    for i, t in enumerate(texts):
        trie.add(t, i, ())
    found = list(trie.terminals())
    assert [t for t, _, _ in found] == sorted(set(texts))
    assert all(least == texts.index(t) and len(entries) == texts.count(t) for t, least, entries in found)


def test_near_copies_take_no_round_an_edit(spark, monkeypatch):
    """F4. Copies that part at many places are dealt by hash after a few rounds; masks are those of one cell."""
    rng = random.Random(6)
    base = "".join(rng.choice("abc ") for _ in range(4000))
    rows = [(i, base[:40 * i] + "X" + base[40 * i + 1:] if i < 90 else base, "a") for i in range(100)]
    rows += [(200 + i, rows[i][1], "b") for i in range(0, 100, 7)] + [(500, "short", "a"), (501, base[:40] + "Y", "b"), (None, base, "a")]
    docs, passes, real = frames(spark, rows, [])[0], [], type(spark.range(0)).mapInArrow
    key = lambda d: sorted(map(str, d.groupBy("doc_id", "part", "mask").sum("n").collect()))
    whole = key(A.masks(docs))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: passes.append(a) or real(*a, **k))
    made = A.masks(docs, cell_bytes=20_000)
    assert len(passes) <= A.ROUNDS + 2 and made.rdd.getNumPartitions() > 10
    assert key(made) == whole
    weights = A.ranges(docs.selectExpr("encode(text, 'utf-8') as text"), 20_000, A.ROUNDS)
    assert weights == sorted(weights) and sum(n for _, n in weights) > 10
