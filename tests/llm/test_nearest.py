"""Recall of the graph search against brute force, with norms as they fall and with norms far apart."""

import numpy as np
import pytest

from wardline.llm import nn_descent


def exact(x, wanted, k=20):
    found = {}
    for q in wanted:
        s = x @ x[q]
        order = np.lexsort((np.arange(len(x)), -s))
        found[q] = [int(i) for i in order if i != q][:k]
    return found


def recall(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    made = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "id % 20 = 0").collect()
    got = {}
    for r in made:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = exact(x, range(0, len(x), 20))
    hits = 0
    for q, ids in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        listed = [got[q][r] for r in range(1, 21)]
        assert all(abs(s - float(x[q] @ x[i])) < 1e-9 * max(1.0, abs(s)) for i, s in listed)
        assert listed == sorted(listed, key=lambda t: (-t[1], t[0])) and q not in [i for i, _ in listed]
        hits += len(set(ids) & {i for i, _ in listed})
    return hits / (20 * len(want))


@pytest.mark.parametrize("kind", ["gaussian", "mixed norms and one outlier"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    if kind != "gaussian":
        x *= (rng.uniform(0.2, 3.0, len(x)) / np.linalg.norm(x, axis=1))[:, None]
        x[17] *= 50 / np.linalg.norm(x[17])
    assert recall(spark, x) >= 0.9


def test_wide_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """F op1_ann. While graph and search run, batches are small; afterwards the session has its own setting again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, real = spark.conf.get(name), [], nn_descent.cut
    monkeypatch.setattr(nn_descent, "cut", lambda df: seen.append(int(spark.conf.get(name))) or real(df))
    x = np.random.default_rng(1).standard_normal((60, 4))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    made = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0")
    assert seen and max(seen) <= nn_descent.ROWS and spark.conf.get(name) == before
    assert made.count() == 60
    with pytest.raises(ValueError):
        nn_descent.nearest(made, "id % 20 = 0")
    assert spark.conf.get(name) == before


def test_a_round_takes_five_shuffles(spark):
    """F2. Neighbours ask for vectors first and are cut down where they meet; what is new is counted where it is made."""
    rng = np.random.default_rng(3)
    vec = np.c_[rng.standard_normal((40, 4)), np.zeros(40)].astype(np.float32)
    rows = [(i, bytearray(vec[i].tobytes()), [0, (i + 1) % 40, (i + 2) % 40], [0.3, 0.2, 0.1], [True, False, True]) for i in range(3, 38)]
    graph, new = spark.createDataFrame(rows, nn_descent.GRAPH), spark.sparkContext.accumulator(0)
    made = nn_descent.merge_into(graph, nn_descent.neighbour_pairs(graph, 3, 0, 2), 3, 0, 2, new)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5
    found = made.collect()
    assert new.value == sum(sum(r.fresh) for r in found) and len(found) == len(rows)


def test_first_rows_of_groups():
    rng = np.random.default_rng(1)
    a, b, order = rng.integers(0, 9, 500), rng.random(500) < 0.5, rng.permutation(500)
    want = {i for x in range(9) for y in (False, True) for i in sorted(np.flatnonzero((a == x) & (b == y)), key=lambda i: order[i])[:4]}
    assert set(nn_descent.first_of(order, 4, b, a).tolist()) == want
    assert not len(nn_descent.first_of(order[:0], 4, b[:0], a[:0]))
