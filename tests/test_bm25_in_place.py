"""Keyword search where documents lie: its rows, what it shuffles and the fast token pattern."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import patterns as P, scan, text as X
from corpusloom.operators import retrieval as R
from corpusloom.session import held


def corpus(spark, n=500, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    rows = [(i, rng.choices(words, [1 / (1 + j) for j in range(90)], k=rng.randint(0, 40))) for i in range(n)] + [(n, None), (n + 1, [])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def questions(spark):
    rng = random.Random(4)
    rows = [(q, [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 8))]) for q in range(40)] + [(90, ["none"]), (91, None), (92, ["w0", "w0"])]
    return spark.createDataFrame(rows, "query_id int, tokens array<string>")


def found(frame):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in frame.collect())


def plain(asked, docs, k):
    """Through rows of (query, document), as the SQL says."""
    counted = R._counted(docs)
    stats = R._stats(counted).first()
    terms = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(counted, "term")
    w = R.idf(F.lit(stats.n_docs), F.col("df"))
    weighted = terms.select("query_id", "term", F.lit(stats.avgdl).alias("avgdl"), (F.col("qtf") * F.when(w < 0, 0.25 * stats.mean_idf).otherwise(w)).alias("weight"))
    by_query = {}
    for r in R._gathered(weighted, docs).collect():
        by_query.setdefault(r.query_id, []).append((-r.score, r.doc_id if r.doc_id is not None else -1, r.doc_id))
    return sorted((q, n + 1, d, round(-s, 5)) for q, x in by_query.items() for n, (s, _, d) in enumerate(sorted(x, key=lambda t: t[:2])[:k]))


def test_no_posting_is_shuffled(spark):
    docs, asked = corpus(spark), questions(spark)
    got = R.bm25(asked, docs, 5)
    tree = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in tree and "Join" not in tree  # the only exchange is that of each task's best
    assert found(got) == plain(asked, docs, 5)
    assert found(R.bm25(asked, docs, 3, pairs=20)) == plain(asked, docs, 3)


def test_small_parts_of_documents(spark, monkeypatch):
    docs, asked = corpus(spark), questions(spark)
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(R, "CELLS", 150)
    rows = spark.createDataFrame([(q, f"t{(q + j) % 7}", 3.0, 1.0 + q) for q in range(30) for j in range(4)], "query_id int, term string, avgdl double, weight double").toArrow()
    scorer = R.Scorer(R._by_term(rows), 4)
    row, term = np.repeat(np.arange(60), 3), np.tile(np.array([0, 2, 5]), 60)
    scorer.add(pa.array(range(60)), np.full(60, 3), row, term, (row % 5 + 1))
    terms = scorer.terms.to_pylist()
    score = lambda q, d: sum((1.0 + q) * (t := d % 5 + 1) * 2.5 / (t + 1.5) for x in (0, 2, 5) if terms[x] in {f"t{(q + j) % 7}" for j in range(4)})
    want = {(q, d) for q in range(30) for d in sorted(range(60), key=lambda d: (-round(score(q, d), 6), d))[:4] if score(q, d) > 0}
    assert {(r["q"], r["d"]) for b in scorer.rows(["q", "d", "s"]) for r in b.to_pylist()} == want
    assert found(R.bm25(asked, docs, 5)) == plain(asked, docs, 5)


def test_ids_that_stand_twice_are_one_document(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "c"]), (2, ["a"]), (None, ["b"]), (None, ["c", "b"]), (3, ["c", "c", "d"]), (4, ["d"])], "doc_id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["d"])], "query_id int, tokens array<string>")
    assert found(R.bm25(asked, docs, 4)) == plain(asked, docs, 4)


def test_no_documents_or_queries(spark):
    docs, asked = corpus(spark), questions(spark)
    assert R.bm25(asked, docs.limit(0), 5).count() == 0 == R.bm25(asked.limit(0), docs, 5).count()
    stats = R.corpus_stats(docs.limit(0)).first()
    assert (stats.n_docs, stats.n_terms) == (0, 0)


def test_held_in_blocks(spark):
    rows, keys = spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "n")], "k long, t string"), spark.createDataFrame([(i,) for i in range(0, 80, 3)] * 2 + [(None,)], "k long")
    for most in (1000, 4):
        assert sorted(r.k for r in held(rows, keys, "k", most=most).collect()) == list(range(0, 50, 3))
        assert sorted(-1 if r.k is None else r.k for r in held(rows, keys, "k", anti=True, most=most).collect()) == [-1] + [i for i in range(50) if i % 3]


def test_the_fast_pattern_finds_the_same_tokens(spark):
    rng = random.Random(6)
    marks = "aZ09. ._+=%<>\\^°µπωΩΔ√∞×÷≤≥⁰¹₉éñóßİſKΩΣж中😀\n"
    texts = ["".join(chr(c) + " " for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x10000, 512)] + ["".join(rng.choices(marks, k=60)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(F.regexp_extract_all("t", F.lit(P.TOKEN), 0).alias("a"), F.regexp_extract_all("t", F.lit(P.TOKEN_SCAN), 0).alias("b"))
    assert both.filter("a <> b").isEmpty() and both.filter("size(a) > 0").count() > 200
    commands = ["".join(rng.choices("\\\\aB1. \n", k=30)) for _ in range(300)]
    jvm = rows.unionByName(spark.createDataFrame([(t,) for t in commands], "t string")).select("t", X.tokens(F.col("t")).alias("x")).collect()
    assert all([t.decode() for t in scan.tokens(r.t.encode())] == r.x for r in jvm)
