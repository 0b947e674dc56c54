"""Long chains of items and long lists of attacks, which once raised."""

import random

import numpy as np

from corpusloom.operators.graph import leader_clusters
from corpusloom.operators.similarity import attack_gate


def plain(ids, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    leader = {}
    for i in sorted(ids):
        leads = [a for a in near.get(i, ()) if leader.get(a) == a]
        leader[i] = min(leads) if leads else i
    return leader


def test_a_chain_of_ten_thousand(spark):
    pairs = [(i, i + 1) for i in range(10_000)]
    found = leader_clusters(spark.range(10_001), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.id: r.leader for r in found} == {i: i - i % 2 for i in range(10_001)}


def test_ranges_settle_as_one_would(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(700)} | {(i, i + 1) for i in range(0, 120)})
    expected = plain(range(320), pairs)
    for size in (1_000_000, 97):
        found = leader_clusters(spark.range(320), spark.createDataFrame(pairs, "a long, b long"), edges_per_range=size).collect()
        assert len(found) == 320 and {r.id: r.leader for r in found} == expected


def test_ids_beyond_doubles_and_strings(spark):
    base = (1 << 60) + 1
    found = leader_clusters(spark.range(base, base + 4), spark.createDataFrame([(base, base + 1), (base + 1, base + 2)], "a long, b long")).collect()
    assert {r.id - base: r.leader - base for r in found} == {0: 0, 1: 0, 2: 2, 3: 3}
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r.id: r.leader for r in leader_clusters(names, spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert leader_clusters(spark.range(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hundred_and_fifty_thousand_attacks(spark):
    rng = np.random.default_rng(2)
    attacks = rng.normal(size=(150_000, 4)) + np.array([3.0, 0, 0, 0])
    items = np.append(rng.normal(size=(40, 4)), attacks[149_990:] * 2.0, axis=0)
    found = attack_gate(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(99, None)], "vec_id long, v array<double>"),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(attacks)], "query_id long, q array<double>"),
    )
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    top = (unit(items) @ unit(attacks).T).max(axis=1)
    got = {r.vec_id: (r.attack, r.top) for r in found.collect()}
    assert set(got) == set(range(50)) and all(abs(got[i][1] - top[i]) < 2e-6 and got[i][0] == (top[i] >= 0.8) for i in got)
    assert all(got[i][1] == 1.0 for i in range(40, 50))
