"""Packing: every id once, three limits, powers of two; token ids against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pytest

from wardline.llm import tokens
from wardline.llm.packing import END_ID, loss_of, pack, pack_documents, power_below, sign_ids
from wardline.llm.tokens import WordIds, load


def held(sequences, lengths, capacity, segments, loss, loss_of_piece):
    """Pieces of each example stand in a row without gap or overlap, and no sequence exceeds a limit."""
    pieces = {}
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert all(n > 0 for _, _, n in s) and total <= capacity and len(s) <= segments
        assert sum(loss_of_piece(i, n) for i, _, n in s) <= loss
        assert total == capacity or total == power_below(total)
        for i, start, n in s:
            pieces.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(pieces.pop(i, [])):
            assert start == at
            at += k
        assert at == n
    assert not pieces


@pytest.mark.parametrize("capacity,segments,loss", [(64, 64, 64), (64, 4, 64), (64, 64, 50), (64, 3, 40), (1, 1, 1)])
def test_three_limits(capacity, segments, loss):
    rng = np.random.default_rng(capacity + segments + loss)
    for size in (0, 1, 7, 300):
        lengths = rng.integers(0, 200, size) * (rng.random(size) < 0.5) + rng.integers(0, 6, size)
        held(pack(lengths, None, capacity, segments, loss), lengths, capacity, segments, loss, lambda i, n: loss_of(n))


def test_limits_of_losses_of_their_own():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 200)
    losses = (lengths * rng.random(200)).astype(int)
    held(pack(lengths, losses, 64, 5, 30), lengths, 64, 5, 30, lambda i, n: -(-losses[i] * n // max(1, lengths[i])))


def test_longest_example_is_the_best_dot_product():
    """Lengths alone: the stacks choose what the scan over all examples would choose."""
    lengths = np.array([30, 20, 14, 9, 5, 3, 1])
    first = pack(lengths, None, 64, 64, 64)[0]
    assert [n for _, _, n in first] == [30, 20, 14]


@pytest.mark.parametrize("memory", [10, 700_000])
def test_ids_are_those_of_the_tokenizer(memory, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", memory)
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(2)
    odd = ["Word", "WORD,", "word.", "don't", "It's", "a<|endoftext|>b", "<|startoftext|>", "é", "Éa!", "ab12", "...", "?!", "x" * 70,
           "Y" * 80 + ".", "\t", "\n", "\x01", " ", "ΑΣ", "ΑΣ.", "İ", "naïve,", "a.b", "A,B", "", "$$", "é", "日本", " "]
    texts = [" ".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(400)] + ["".join(rng.choice(odd, 8)) for _ in range(400)]
    words, plain = WordIds(path), load(path)
    for at in range(0, 800, 40):
        for text, ids in zip(texts[at:at + 40], words.many(texts[at:at + 40])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert [len(x) for x in words.many([None, ""])] == [0, 0]


def test_documents_are_packed_by_vectors(spark):
    """F7. Signs bear no loss, so of equally long texts the dot product takes the one with more loss; loss_tokens counts it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    quiet = sign_ids(path)
    plain = load(path)
    texts = ["word " * 300, ". , " * 150, "", None, "a b . " * 2000, "?! " * 40, "one two three " * 60]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    made = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, with_ids=True, quiet=quiet).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in rows}
    assert END_ID not in quiet and set(plain.encode(". ,", add_special_tokens=False).ids) <= set(quiet)
    assert not set(plain.encode("word", add_special_tokens=False).ids) & set(quiet)
    found, filled = {}, {}
    for r in made:
        assert r["ids"] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["loss_tokens"] == sum(x not in quiet for x in r["ids"][1:])
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    for i, whole in ids.items():
        at = 0
        for start, n in sorted(found[i]):
            assert start == at
            at += n
        assert at == len(whole)
    assert all(n == 4096 or n == power_below(n) for n in filled.values())
    lengths, losses = np.array([30, 30, 20]), np.array([3, 29, 19])
    assert pack(lengths, losses, 64, 64, 64)[0][0][0] == 1


def test_a_worker_remembers_no_more_than_it_may(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    words = WordIds(path, 1000)
    for i in range(20):
        words.many([" ".join(f"piece{k}" for k in range(500 * i, 500 * i + 500))])
        assert len(words.known) + len(words.older) <= 2 * (1000 + 500)
    rows = [(i, " ".join(f"{'x' * (k % 7)}{i * k}" for k in range(i))) for i in range(200)] + [(None, None), (3, "a\U0001F600 b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one, other = (pack_documents(docs, path, with_ids=True, **more).collect() for more in ({}, {"remembered": 50}))
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_a_piece_is_looked_up_once_a_batch():
    """F1. A piece that recurs within a batch of texts costs one search of the worker's memory, not one each time it stands there."""
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

        def __contains__(self, key):
            Counted.asked += 1
            return dict.__contains__(self, key)

        def __getitem__(self, key):
            Counted.asked += 1
            return dict.__getitem__(self, key)

    path = public_tokenizers.path("word_bpe_49k.json")
    words, texts = WordIds(path), ["The same words again, Été and 12 " * 400, None] * 3
    words.known = Counted()
    found = words.many(texts)
    assert [x.tolist() for x in found] == [load(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert words.direct and Counted.asked < 200
