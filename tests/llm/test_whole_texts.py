"""Terms that give personal data away, against counts over whole texts."""

import math
import re

import numpy as np

from tests.llm.test_rows import words
from wardline.llm import sanitise

MAIL = re.compile(r"[a-z0-9]+@[a-z]+\.example")


def revealing(texts):
    """``{text: {term: part}}`` from plain counts of every (address, term) pair."""
    texts = sorted(set(texts))
    said = {t: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in texts}
    holds = {t: set(MAIL.findall(t)) for t in texts}
    n, part = len(texts), {}
    for e in set().union(*holds.values()):
        with_e = [t for t in texts if e in holds[t]]
        for w in set().union(*(said[t] for t in with_e)):
            both, n_w = sum(w in said[t] for t in with_e), sum(w in said[t] for t in texts)
            info = -math.log2(len(with_e) / n)
            if both >= 3 and info > 0:
                x = math.log2(n * both / (len(with_e) * n_w)) / info
                part[w] = max(x, part.get(w, -1))
    return {t: {w: part[w] for w in said[t] if part.get(w, 0) >= 0.8} for t in texts}


def test_a_name_in_the_heading_far_from_the_address(spark):
    rng = np.random.default_rng(8)
    common = words(50, 60).split()
    texts = []
    for i in range(200):
        body = [*words(1000 + i, 40).split(), *rng.choice(common, 40)]
        rng.shuffle(body)
        if i % 20 == 0:
            body = ["Zebrafish", *body, "mail a@x.example now"]
        if i % 50 == 1:
            body = ["Quillwort", *body, "write b@y.example", "today"]
        if i % 25 == 2:
            body = [*body, "quillwort"] if i == 2 else ["b@y.example", *body]
        texts.append(" ".join(body))
    texts += [texts[0], texts[1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = sanitise.sanitise(docs).collect()
    expected = revealing([t or "" for t in texts])
    assert any("zebrafish" in x for x in expected.values())
    for r in made:
        spans = {(s.value.lower(), s.kind) for s in r.san_spans if s.kind in ("term", "omit")}
        masked = {m.span() for m in MAIL.finditer(r.text or "")}
        outside = {w for w in expected[r.text or ""] if any(
            not any(a < m.end() and m.start() < b for a, b in masked) for m in re.finditer(rf"(?<![^\W\d_]){w}(?![^\W\d_])", (r.text or "").lower()))}
        assert spans == {(w, "omit" if expected[r.text or ""][w] >= 0.95 else "term") for w in outside}, r.doc_id
    assert not any("zebrafish" in r.san_clean.lower() for r in made)
