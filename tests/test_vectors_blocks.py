"""The product by blocks gives what a plain one gives."""

import numpy as np
import pytest

from lectern.operators import vectors as V


def plain_version(rows, queries, k):
    out = {}
    for name, q in queries:
        scores = []
        for i, v in rows:
            if v is None or q is None or not len(q) or len(v) != len(q) or i == name:
                continue
            a, b = np.array(v, np.float32).astype(float), np.array(q, float)
            length = np.linalg.norm(a) * np.linalg.norm(b)
            scores.append((-round(float(a @ b / length) if length else 0.0, 6) + 0.0, i))
        out[name] = [(i, -s + 0.0) for s, i in sorted(scores)[:k]]
    return {q: found for q, found in out.items() if found}


@pytest.mark.parametrize(("block", "k"), [(1 << 16, 3), (7, 3), (7, 500), (1, 1)])
def test_nearest(spark, block, k):
    rng = np.random.default_rng(5)
    n = 30 if block == 1 else 400
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(n)] + [(1000 + i, [1.0, 2.0, 2.0, 0.0]) for i in range(n // 3)]  # many ties, a third are copies
    rows += [(2000, [0.0] * 4), (2001, [1.0, 2.0]), (2002, None), (2003, [])]
    queries = [(i, rows[i][1]) for i in range(0, n, 25)] + [(5000, [2.0, 4.0, 4.0, 0.0]), (5001, [0.0] * 4), (5002, [3.0, 1.0]), (5003, [1.0] * 9), (5004, None), (5005, [])]
    found = V.nearest(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), spark.createDataFrame(queries, "query int, q array<double>"), k, block)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert got == plain_version(rows, queries, k)


def test_sub_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(V, "QUERIES_AT_ONCE", 3)
    import pandas as pd

    rng = np.random.default_rng(6)
    rows = [(int(i), rng.integers(-1, 2, 3).astype(float).tolist()) for i in rng.permutation(90)]
    queries = [(100 + i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(8)]
    found = V._closest(4, 6)(pd.DataFrame(rows, columns=["id", "v"]), pd.DataFrame(queries, columns=["query", "q"]))
    best = found.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(4)
    assert {q: list(zip(g["id"], g["score"], strict=True)) for q, g in best.groupby("query")} == plain_version(rows, queries, 4)


def test_nothing(spark):
    none, some = spark.createDataFrame([], "id long, v array<double>"), spark.createDataFrame([(1, [1.0])], "query int, q array<double>")
    assert V.nearest(none, some, 3).collect() == [] and V.nearest(some.toDF("id", "v"), none.toDF("query", "q"), 3).collect() == []
