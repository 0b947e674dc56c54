"""The risk, its gradient with the sign switch, the moments and the prior, each against plain sums over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.quality_classifier import N_STATS, ClassifierSpec, Moments, best_bin_prior, feature_table, features, fit, gradient, moments, risk


def rows(seed, n, shift):
    return np.random.default_rng(seed).normal(shift, 1.0, (n, 4))


def plain_risk(w, xp, xu, prior):
    loss = lambda z: (1 - z) ** 2 / 4
    g = lambda x: np.hstack([x, np.ones((len(x), 1))]) @ w
    return prior * loss(g(xp)).mean(), loss(-g(xu)).mean() - prior * loss(-g(xp)).mean()


@pytest.mark.parametrize("prior", [0.2, 0.9])
@pytest.mark.parametrize("seed", range(6))
def test_risk_and_gradient_against_rows(prior, seed):
    xp, xu, w = rows(seed, 50, 1.0), rows(seed + 9, 80, 0.3), np.random.default_rng(seed).normal(0, 1 + seed, 5)
    p, u = (Moments.of(x).scaled(np.zeros(4), np.ones(4)) for x in (xp, xu))
    assert risk(w, p, u, prior) == pytest.approx(plain_risk(w, xp, xu, prior))
    positive, rest = plain_risk(w, xp, xu, prior)
    chosen = (lambda v: sum(plain_risk(v, xp, xu, prior))) if rest >= 0 else (lambda v: -plain_risk(v, xp, xu, prior)[1])
    numeric = [(chosen(w + d) - chosen(w - d)) / 2e-6 for d in np.eye(5) * 1e-6]
    assert gradient(w, p, u, prior) == pytest.approx(np.array(numeric), rel=1e-4, abs=1e-6)


def test_both_signs_occur():
    signs = set()
    for seed in range(40):
        xp, xu, w = rows(seed, 50, 1.0), rows(seed + 9, 80, 0.9), np.random.default_rng(seed).normal(0, 1, 5)
        signs.add(plain_risk(w, xp, xu, 0.95)[1] >= 0)
    assert signs == {True, False}


def test_fit_never_ends_far_below_zero():
    xp, xu = rows(1, 200, 1.0), np.vstack([rows(2, 300, 1.0), rows(3, 100, -1.5)])
    model = fit(Moments.of(xp), Moments.of(xu), 0.75)
    ready = lambda x: (x - model.mean) / model.scale
    assert plain_risk(model.weights, ready(xp), ready(xu), 0.75)[1] > -0.02
    assert (model.scores(rows(4, 200, 1.0)) >= 0.5).mean() > 0.85 and (model.scores(rows(5, 200, -1.5)) < 0.5).mean() > 0.85


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_without_negatives(prior):
    rnd = np.random.default_rng(7)
    n = 20_000
    positive = np.clip(rnd.normal(0.8, 0.1, n), 0, 1)
    mixed = np.concatenate([np.clip(rnd.normal(0.8, 0.1, int(prior * n)), 0, 1), np.clip(rnd.normal(0.25, 0.1, n - int(prior * n)), 0, 1)])
    counts = [np.bincount(np.round(x * 1000).astype(int), minlength=1001) for x in (positive, mixed)]
    assert best_bin_prior(*counts, 0.1, 0.5) == pytest.approx(prior, abs=0.03)
    assert best_bin_prior(counts[0] * 0, counts[1], 0.1, 0.5) == 0.5


def test_moments_take_all_teaching_rows(spark):
    spec = ClassifierSpec()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(7)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    table = feature_table(docs, labels, spec)
    found = moments(table, spec)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    teach = docs.filter(fold != 2).collect()
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    for positive in (False, True):
        x = np.array([features((r["text"] or "").encode(), spec.shapes) for r in teach if not positive or r["doc_id"] in good])
        want, got = Moments.of(x), found[positive, 0] + found[positive, 1]
        assert got.n == want.n and got.first == pytest.approx(want.first, rel=1e-5) and got.second == pytest.approx(want.second, rel=1e-5)
        assert len(want.first) == N_STATS + spec.shapes + 1
