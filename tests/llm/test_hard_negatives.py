"""Hard negatives against all pairs in Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as H
from corpusloom.llm.hard_negatives import Best, NegativeSpec, Rows, band, hard_negatives, products, survivors

TYPE = "vec_id long, label int, embedding array<double>"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def plain(rows, spec, every):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, label, [min(max(math.floor(spec.scale * x), LEAST), MOST) for x in v]))
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), LEAST), MOST)
    anchors = {}
    for i, label, v in sorted(kept, key=lambda r: (r[0], r[1], r[2])):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        same = sorted((-score(v, w), i) for i, l, w in kept if l == label and i != a)[: spec.positives]
        others = sorted((-score(v, w), i) for i, l, w in kept if l != label)
        for s, p in same:
            fit = [(n, i) for n, i in others if spec.low * -s <= 100 * -n <= spec.high * -s][: spec.negatives]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, spec, every, extra=False):
    frame = spark.createDataFrame(rows, TYPE).repartition(3)
    if extra:
        frame = frame.withColumn("score", F.lit(1)).withColumn("a", F.lit("x")).withColumn("rank", F.lit(None).cast("int"))
    got = hard_negatives(frame, F.col("vec_id") % every == 0, spec)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_random_vectors_in_blocks(spark):
    rng = np.random.default_rng(7)
    axes = np.linalg.qr(rng.normal(size=(12, 12)))[0] * np.geomspace(1, 0.01, 12)
    rows = [(int(i), int(rng.integers(3)), (rng.normal(size=12) @ axes.T + 0.2).tolist()) for i in range(400)]
    rows = [(i, 0 if i % 3 == 0 else l, v) for i, l, v in rows]  # one label holds more than a third
    for spec in (NegativeSpec(), NegativeSpec(block=7, rows=16), NegativeSpec(positives=2, negatives=3, low=10, high=100, levels=(1.0,))):
        expected = plain(rows, spec, 20)
        assert expected and mined(spark, rows, spec, 20) == expected


def test_odd_rows(spark):
    one = [0.5, 0.25, -0.125]
    rows = [(0, 1, one), (100, 1, one), (200, None, one), (300, 2, None), (400, 2, [0.1, None, 0.2]), (500, 2, [0.1, float("nan"), 0.2]), (600, 2, [float("inf"), 0.0, 0.0])]
    rows += [(None, 1, one), (700, 3, []), (800, 2, [0.5]), (900, 2, [0.5, 0.25, -0.125, 9.0]), (1000, 2, [-0.5, -0.25, 0.125])]
    rows += [(1, 1, one), (1, 1, one), (2, 1, one), (3, 2, [0.4, 0.2, -0.1]), (4, 2, [0.4, 0.2, -0.1]), (4, 2, [0.4, 0.2, -0.1]), (5, 3, [0.4, 0.2, -0.1]), (0, 2, [0.3, 0.3, 0.3]), (6, 4, [0.25, 0.1, -0.06])]
    for spec in (NegativeSpec(), NegativeSpec(negatives=2, positives=3, block=2)):
        expected = plain(rows, spec, 100)
        assert {r[0] for r in expected} >= {0, 100} and mined(spark, rows, spec, 100) == expected
        assert mined(spark, rows, spec, 100, extra=True) == expected


def test_numbers_beyond_64_bits(spark):
    big = 2.0**40
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 2.0]), (2, 1, [1.0, 1.0]), (3, 2, [big / 2, 1.0]), (4, 2, [0.5, 0.0]), (5, 2, [1e300, -1e300]), (6, 1, [2.0**54, 1.0]), (7, 2, [0.25, 0.25])]
    spec = NegativeSpec()
    expected = plain(rows, spec, 1)
    assert expected and mined(spark, rows, spec, 1) == expected


def test_empty_tables(spark):
    assert mined(spark, [], NegativeSpec(), 100) == []
    assert mined(spark, [(1, 1, [0.5]), (2, 2, [0.5])], NegativeSpec(), 100) == []
    assert mined(spark, [(0, None, [0.5]), (100, 2, None)], NegativeSpec(), 100) == []


def test_bands_are_exact():
    for s in (*range(-50, 200), 10**17 + 3, 2**62):
        low, high = band(s, NegativeSpec())
        assert 30 * s <= 100 * low < 30 * s + 100 and 90 * s - 100 < 100 * high <= 90 * s


def test_bounds_hold_and_discard(spark):
    """No pair that reaches the limit is discarded, and most others are, before their integers are multiplied."""
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(600, 32)) * np.geomspace(1, 0.01, 32)
    ints = np.floor(256 * spread @ np.linalg.qr(rng.normal(size=(32, 32)))[0]).astype(np.int64)
    frame = spark.createDataFrame([(r.tolist(),) for r in ints], "v array<long>")
    axes = H.rotation(frame)
    assert np.allclose(axes.T @ axes, np.eye(32))
    strengths = ((ints @ axes) ** 2).sum(axis=0)
    assert np.all(np.diff(strengths) <= 1e-6 * strengths[0])
    all_ = Rows(np.arange(600), np.zeros(600), ints, axes, NegativeSpec().levels)
    few = Rows(np.arange(40), np.zeros(40), ints[:40], axes, NegativeSpec().levels)
    exact = ints[:40] @ ints.T
    limit = np.partition(exact, -10, axis=1)[:, -10].astype(float)
    i, j, s = survivors(few, all_, np.ones((40, 600), bool), lambda at, lower, upper: upper >= (limit[at] if lower.ndim == 1 else limit[:, None]))
    assert np.array_equal(s, exact[i, j]) and np.array_equal(s, products(few, i, all_, j))
    reached = set(zip(*np.nonzero(exact >= limit[:, None]), strict=True))
    assert reached <= set(zip(i, j, strict=True)) and len(i) < 0.1 * exact.size


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, -3]), np.array([9, 8, 1]))
    best.add(np.array([0, 0, 1]), np.array([5, 4, -(1 << 63)]), np.array([7, 1, 2]))
    assert list(zip(best.key, best.score, best.id, strict=True)) == [(0, 5, 7), (0, 5, 8), (1, -3, 1), (1, -(1 << 63), 2)]
    assert best.least[0] == 5
