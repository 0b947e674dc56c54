"""The stored vector index: exact rows, recall, folders read and kept."""

import pathlib
import tempfile

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import similarity as S
from corpusloom.operators.vector_index import VectorIndex, fit_centres, fit_probes


def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def clustered(spark, n=1500, d=16, groups=30, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d))
    rows = [(int(i), (middle[i % groups] + 0.3 * rng.normal(size=d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>")


def asked(rows, every=25):
    return rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def listed(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_exact_rows_are_those_of_the_plain_search(spark):
    rows = clustered(spark)
    index = VectorIndex(spark, root(), cells=60)
    for m in (1, 3, 5):
        index.insert(rows.filter(F.floor(F.col("vec_id") / 30) % 5 < m))  # all groups in each
    assert index.versions() == [1, 2, 3] and index.vectors().count() == 1500
    assert listed(index.search(asked(rows), 10, exact=True)) == listed(S.nearest(asked(rows), rows, 10))
    assert index.opened < 0.5 * 60 * len(index.centres()[0])  # bounds leave most cells closed


def test_recall_on_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    index = VectorIndex(spark, root())
    index.insert(e)
    assert index.recall(asked(e, 20), 10) >= 0.95
    rows = clustered(spark)
    index = VectorIndex(spark, root())
    index.insert(rows)
    assert index.recall(asked(rows), 10) >= 0.95 and index.centres()[1] < len(index.centres()[0]) / 2


def test_a_search_reads_only_the_cells_it_wants(spark):
    rows = clustered(spark)
    index = VectorIndex(spark, root())
    index.insert(rows)
    one = asked(rows, 10_000)
    expected = listed(index.search(one, 5, probes=2))
    near = np.argsort(-np.array(one.first().q) / np.linalg.norm(one.first().q) @ index.centres()[0].T)[:2]
    for folder in pathlib.Path(index.root.removeprefix("file://")).glob("vectors/version=1/cell=*"):
        if int(folder.name[5:]) not in near:
            for f in folder.iterdir():
                f.write_bytes(b"broken")
    assert len(expected) == 5 and listed(index.search(one, 5, probes=2)) == expected


def test_inserts_leave_other_files_alone(spark):
    rows = clustered(spark)
    index = VectorIndex(spark, root())
    base = pathlib.Path(index.root.removeprefix("file://"))
    seen = lambda: {p: p.stat().st_mtime_ns for p in base.rglob("*") if p.is_file()}
    assert index.insert(rows.filter("vec_id < 900")) == 1
    before = seen()
    assert index.insert(rows.filter("vec_id < 300")) == 1 and seen() == before
    assert index.insert(rows) == 2
    after = seen()
    assert {p: after[p] for p in before} == before


def test_odd_rows(spark):
    index = VectorIndex(spark, root())
    kind = "vec_id long, v array<float>, cell string"
    assert index.insert(spark.createDataFrame([], kind)) == 0
    question = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [-1.0, -1.0])], "query_id long, q array<double>")
    assert index.search(question, 3).count() == 0
    odd = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (2, [0.0, 0.0], None), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (6, [1.0, 0.0], "x"), (7, [0.5, 0.5], "x"), (8, [-1.0, 0.2], "x")]
    assert index.insert(spark.createDataFrame(odd, kind)) == 1
    sound = spark.createDataFrame([(i, v) for i, v in {r[0]: r[1] for r in odd if r[0] in (1, 2, 6, 7, 8)}.items()], "vec_id long, v array<double>")
    good = question.filter("query_id is not null and q is not null")
    for k in (1, 3, 10):
        assert listed(index.search(question, k, exact=True)) == listed(S.nearest(good, sound, k))


def test_fitting():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(500, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centres = fit_centres(sample, 20)
    assert centres.shape == (20, 8) and np.bincount((sample @ centres.T).argmax(axis=1), minlength=20).min() > 0
    few, many = fit_probes(sample, centres, 10, 0.5), fit_probes(sample, centres, 10, 0.97)
    assert 1 <= few < many <= 20
    assert fit_probes(sample[:1], centres, 10, 0.97) == 20
