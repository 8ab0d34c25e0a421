"""The mix does not depend on how many rows a task ranks."""

import numpy as np

from wardline.llm import mixing


def test_crowded_cells_keep_the_order(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(20, 24))), "hot") for i in range(300)]
    rows += [(1000 + i, " ".join(["w"] * 20), "hot") for i in range(150)]
    rows += [(2000 + i, " ".join(["w"] * int(rng.integers(1, 90))), "cold") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda: {r.doc_id: r.mix_copies for r in mixing.mix(docs).select("doc_id", "mix_copies").collect()}
    one = taken()
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    most = {}
    placed = mixing.counted

    def counted(sized):
        cells = placed(sized)
        most["rows"] = max(r.rows for r in cells.collect())
        return cells

    monkeypatch.setattr(mixing, "counted", counted)
    assert taken() == one and most["rows"] < 40
