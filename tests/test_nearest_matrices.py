"""Vector search in matrices: no pair becomes a row, and odd vectors keep their places."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import similarity as S
from corpusloom.operators.best import Best, half_up


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_pair_becomes_a_row(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8)).round(1)
    v[300:600] = v[:300]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<float>")
    asked = rows.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = S.nearest(asked, rows, 4)
    assert "NestedLoopJoin" not in plan(found) and "CartesianProduct" not in plan(found)
    u = v.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    score = half_up(u @ u.T, 6)
    want = {(q, int(d), n + 1) for q in range(0, 900, 3) for n, d in enumerate(np.lexsort((np.arange(900), -score[q]))[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == want
    few = S.nearest(asked, rows, 4, block=50)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in few.collect()} == want


def test_odd_vectors(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [None, 1.0])], "vec_id string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [3.0])], "query_id int, q array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in S.nearest(asked, rows, 4).collect()}
    assert [found[1, k] for k in range(1, 5)] == [("a", 1.0), ("b", 1.0), ("d", 0.0), ("c", None)]
    assert [found[2, k] for k in range(1, 5)] == [(x, None) for x in "abcd"]
    assert found[3, 1] == ("e", 1.0) and len(found) == 12
    assert {(r.query_id, r.vec_id) for r in S.nearest(asked, rows, 4, least=0.5).collect()} == {(1, "a"), (1, "b"), (3, "e")}
    assert S.nearest(asked.limit(0), rows, 4).count() == 0 == S.nearest(asked, rows.limit(0), 4).count()


def test_best_in_small_parts():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    scores = rng.integers(0, 30, size=(500, 7)) / 10
    best = Best(7, 6, 6)
    best.most = 20
    for at in range(0, 500, 9):
        best.add(scores[at : at + 9], pa.array(np.arange(500)[at : at + 9]))
    found = [(r["q"], r["i"]) for b in best.rows(["q", "i", "s"], pa.array(range(7))) for r in b.to_pylist()]
    assert found == [(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(500), -scores[:, q]))[:6]]
