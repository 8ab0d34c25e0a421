"""What estimates and classifiers are worth: recall of the similarity join, held-out toxicity."""

import numpy as np
import pytest

from wardline.llm import queries
from wardline.llm.jaccard_join import recall_of, similar_texts

SF = "/root/testdata/sf0.1"


def test_large_groups_do_not_hide_lone_pairs(spark):
    group = [(h, 0, 10 + i) for i in range(500) for h in (0, 1)]
    pairs = [(i % 2, 1000 + 2 * i, 1001 + 2 * i) for i in range(8)] + [(h, 2000, 2001) for h in (0, 1)]
    kind = "half int, a long, b long"
    assert recall_of(spark.createDataFrame(group, kind)) == 1.0
    # Of nine lone pairs one half finds five, the other five, both one: together 1 - 0.8 * 0.8.
    assert recall_of(spark.createDataFrame(group + pairs, kind)) == pytest.approx(0.36)
    assert recall_of(spark.createDataFrame(pairs[:8], kind)) == 0.0
    assert recall_of(spark.createDataFrame([], kind)) == 1.0


def test_a_target_that_no_estimate_reaches_is_refused(spark):
    with pytest.raises(ValueError, match="below 1"):
        similar_texts(spark.createDataFrame([], "doc_id long, text string"), target=1.0)


def test_toxicity_of_texts_held_out(spark):
    made = queries.op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = [(r["toxic"], r["score"], r["predicted"]) for r in made.where("held_out").collect()]
    good, bad = ([s for y, s, _ in rows if y == k] for k in (0, 1))
    assert len(bad) >= 30 and len(good) >= 300
    above = np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])
    caught = np.mean([p for y, _, p in rows if y == 1])
    false = np.mean([p for y, _, p in rows if y == 0])
    print(f"AUC {above:.4f}, caught {caught:.3f} of {len(bad)}, clean flagged {false:.3f} of {len(good)}")
    assert above >= 0.95 and caught >= 0.8 and false <= 0.05  # measured: 0.972, 81 of 97, 0 of 728
