"""Fragments of many queries against a plain search."""

import random
import re

from corpusloom.operators.fragments import fragment_hits


def form(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", "", text).lower()


def plain(queries, docs, k):
    out = []
    for q in sorted({q for q, _ in queries if q is not None}):
        own = [form(f) for p, f in queries if p == q and f is not None and len(form(f)) >= 2]
        met = sorted({i for i, t in docs if i is not None and t is not None and any(f in form(t) for f in own)})[:k]
        out += [(q, i, r) for r, i in enumerate(met, 1)]
    return sorted(out)


def found(spark, queries, docs, k, **how):
    q = spark.createDataFrame(queries, "query_id long, fragment string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, fragment_hits(q, d, k, **how).collect()))


def test_random_fragments_in_blocks_and_with_short_anchors(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abB \n", k=n))
    docs = [(i, word(rng.randint(0, 60))) for i in range(120)]
    queries = [(rng.randint(0, 30), word(rng.randint(0, 9))) for _ in range(150)]
    for k, how in ((3, {}), (1, {"block": 40}), (200, {"anchor": 2, "block": 100})):
        assert found(spark, queries, docs, k, **how) == plain(queries, docs, k)


def test_odd_rows(spark):
    long = "x" * 70 + "y" * 70
    docs = [(1, "A = b"), (1, "A = b"), (None, "a=b"), (2, None), (3, ""), (4, long), (5, "x" * 70 + "z"), (6, "ÄÖ $\\alpha$"), (7, "a=b" * 50_000)]
    queries = [(1, "a=B"), (1, "a=B"), (2, "a"), (3, None), (None, "a=b"), (4, long), (5, " äö "), (6, "\\alpha"), (7, "not there"), (8, "")]
    assert found(spark, queries, docs, 5) == plain(queries, docs, 5)
    assert found(spark, [], docs, 5) == [] and found(spark, queries, [], 5) == []


def test_a_fragment_of_every_text_sends_few_rows(spark):
    docs = [(i, f"the same {i}") for i in range(3000)]
    assert found(spark, [(1, "the same")], docs, 4) == [(1, i, i + 1) for i in range(4)]
