"""Reply trees against a plain walk over random trees that share node ids."""

import random

from wardline.llm import chat


def best_paths(rows, top):
    parents = {}
    for tree, node, parent, score in rows:
        parents.setdefault(tree, {})[node] = (parent, score or 0.0)
    out = set()
    for tree, nodes in parents.items():
        found = []
        for leaf in set(nodes) - {p for p, _ in nodes.values()}:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            found.append((-sum(nodes[n][1] for n in path) / len(path), leaf, path[::-1]))
        for branch, (_, _, path) in enumerate(sorted(found)[:top], 1):
            out |= {(tree, branch, i, n) for i, n in enumerate(path)}
    return out


def test_branches_equal_a_plain_walk(spark):
    rng, rows = random.Random(2), []
    for tree in range(150):
        for i in range(rng.randrange(1, 14)):
            parent = None if i == 0 or rng.random() < 0.05 else f"n{rng.randrange(i):02d}"
            rows.append((tree, f"n{i:02d}", parent, rng.choice([None, 0.0, 0.25, 0.5, 1.0])))
        if rng.random() < 0.2:
            rows.append((tree, "stray", "nowhere", 0.5))
    for top in (1, 3):
        made = chat.branches(spark.createDataFrame(rows, "tree long, node string, parent string, score double"), top).collect()
        assert len(made) == len(set(made)) and {(r.tree, r.branch, r.position, r.node) for r in made} == best_paths(rows, top)


def test_formatted_branches_of_trees_that_share_ids(spark):
    rows = [(t, "r", None, 0.0, "user", f"ask {t}") for t in (1, 2)] + [(1, "a", "r", 0.9, "assistant", "good"), (1, "b", "r", 0.1, "assistant", "bad"),
                                                                       (2, "a", "r", 0.2, "assistant", "fine")]
    nodes = spark.createDataFrame([*rows, rows[0]], "tree long, node string, parent string, score double, role string, text string")
    made = {(r.tree, r.branch): r.formatted for r in chat.format_branches(nodes, 2).collect()}
    assert set(made) == {(1, 1), (1, 2), (2, 1)}
    assert "ask 1" in made[1, 1] and "good" in made[1, 1] and "bad" in made[1, 2] and "fine" in made[2, 1] and "ask 2" in made[2, 1]
