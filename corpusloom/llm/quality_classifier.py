"""Quality classifier by positive-unlabelled learning.

A linear score g is fitted to trusted positives and unlabelled web text alone, by
the non-negative unbiased risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])

with the quadratic loss l(z) = (1 - z)^2 / 4; where the second part is negative,
its gradient is taken backwards, so that the fit can't explain positives away.
With this loss the risk depends on the texts through their features' first and
second moments alone, so all unlabelled text takes part: one pass sums the
moments in every task, and the fit sees matrices whose size depends on the
number of features.  A text's score is (1 + g) / 2, between 0 and 1.

No negative is used, for the class prior neither: a first fit on one half of the
texts scores the other half, and the prior is the share of unlabelled texts in
the best bin of scores over that of positives, with a bound on the chance of
both (best-bin estimation).

Features are surface statistics of the whole text and a hashed histogram of its
word shapes; language, source, id and labels are none of them.  They are computed
once and kept as a table in the shared folder.  The positives that teach are about
``max_positives`` at most, chosen by a hash of their id.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.workspace import arrow_map, fresh_dir, slices


@dataclass(frozen=True)
class ClassifierSpec:
    """max_positives: labelled rows that teach, about so many at most; first_prior: of the fit whose scores give the prior; bins: of those scores; risk: chance that the prior's bound fails."""

    max_positives: int = 100_000
    shapes: int = 128
    rounds: int = 600
    rate: float = 0.02
    penalty: float = 1e-3
    first_prior: float = 0.5
    bins: int = 1000
    risk: float = 0.1
    threshold: float = 0.7
    held_out_fold: int = 2
    folds: int = 4


_SHAPE = bytes(ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_LETTERS = re.compile(rb"aa+")
_CAPITALS = re.compile(rb"AA+")
N_STATS = 14


def features(text: bytes, shapes: int) -> np.ndarray:
    """Square roots of statistics and of shares of hashed word shapes; all zero but for the first in a wordless text."""
    out = np.zeros(N_STATS + shapes, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    shape = text.translate(_SHAPE)
    upper, digits, letters = shape.count(b"A"), shape.count(b"0"), shape.count(b"a")
    size = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[1] = np.log1p(n) / 10
    out[2] = size / n / 10
    out[3] = np.log1p(len(counts)) / np.log1p(n)
    out[4] = max(counts.values()) / n
    out[5] = upper / size
    out[6] = digits / size
    out[7] = (size - letters - upper - digits) / size
    out[8] = len(lines) / n
    out[9] = 1 - len(set(lines)) / max(1, len(lines))
    out[10] = pairs / max(1, n - 1)
    out[11] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[12] = min(n, 50) / 50
    out[13] = max(map(len, words)) / size
    for form, c in Counter(_CAPITALS.sub(b"A", _LETTERS.sub(b"a", shape)).split()).items():
        out[N_STATS + zlib.crc32(form) % shapes] += c / n
    return np.sqrt(out)  # evens out rare shares, which a quadratic loss would follow


@dataclass
class Moments:
    """Sums over n rows: of x with a one at its end, and of its products."""

    n: int
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        z = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
        return cls(len(z), z.sum(0), z.T @ z)

    @classmethod
    def none(cls, width: int) -> "Moments":
        return cls(0, np.zeros(width + 1), np.zeros((width + 1, width + 1)))

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def scaled(self, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of z and of its products once x is centred and scaled."""
        t = np.diag(np.append(1 / scale, 1.0))
        t[:-1, -1] = -mean / scale
        return t @ self.first / self.n, t @ self.second @ t.T / self.n


def risk(w: np.ndarray, p: tuple, u: tuple, prior: float) -> tuple[float, float]:
    """(prior * E_p[l(g)], E_u[l(-g)] - prior * E_p[l(-g)]) from the means (first, second) of both kinds."""
    loss = lambda sign, m: float(1 - 2 * sign * (w @ m[0]) + w @ m[1] @ w) / 4
    return prior * loss(1, p), loss(-1, u) - prior * loss(-1, p)


def gradient(w: np.ndarray, p: tuple, u: tuple, prior: float) -> np.ndarray:
    """Of the whole risk; backwards and of the second part alone where that is negative."""
    part = lambda sign, m: (m[1] @ w - sign * m[0]) / 2
    rest = part(-1, u) - prior * part(-1, p)
    return prior * part(1, p) + rest if risk(w, p, u, prior)[1] >= 0 else -rest


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.clip((1 + g) / 2, 0.0, 1.0)


def fit(positive: Moments, unlabelled: Moments, prior: float, spec: ClassifierSpec = ClassifierSpec()) -> Model:
    """Adam on the non-negative risk of the moments; without rows of either kind every score is 0.5."""
    k = len(unlabelled.first) - 1
    if not positive.n or not unlabelled.n:
        return Model(np.zeros(k + 1), np.zeros(k), np.ones(k), prior)
    mean = unlabelled.first[:-1] / unlabelled.n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(unlabelled.second)[:-1] / unlabelled.n - mean**2, 0)), 1e-3)
    p, u = positive.scaled(mean, scale), unlabelled.scaled(mean, scale)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, spec.rounds + 1):
        grad = gradient(w, p, u, prior)
        grad[:-1] += spec.penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - spec.rate * (1 - 0.9 * step / spec.rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale, prior)


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, risk: float, default: float) -> float:
    """Share of positives in unlabelled text from counts of both kinds by rising score; the default without rows of either."""
    n_p, n_u = int(positive.sum()), int(unlabelled.sum())
    if not n_p or not n_u:
        return default
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / n for x, n in ((positive, n_p), (unlabelled, n_u)))
    some = above_p > 0
    doubt = sum(math.sqrt(math.log(4 / risk) / 2 / n) for n in (n_p, n_u))
    best = np.argmin((above_u[some] + doubt) / above_p[some])
    return float(np.clip((above_u[some] / above_p[some])[best], 0.02, 0.98))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def feature_table(docs: DataFrame, labels: DataFrame, spec: ClassifierSpec = ClassifierSpec()) -> DataFrame:
    """(doc_id, x, half, positive) of every row: features as float32 bytes; half is null for rows that may not teach."""
    spark = docs.sparkSession
    usable = labels.filter((fold_of(F.col("doc_id"), spec.folds) != spec.held_out_fold) & (F.col("quality") == 1))
    chosen = usable.select(F.col("doc_id").cast("long").alias("label_id")).distinct()
    n = chosen.count()
    if n > spec.max_positives:
        chosen = chosen.filter(F.pmod(F.xxhash64("label_id"), F.lit(n)) < spec.max_positives)
    chosen = chosen.withColumn("positive", F.lit(True))
    held = F.coalesce(fold_of(F.col("doc_id"), spec.folds) == spec.held_out_fold, F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = base.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", F.when(~held, F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")).alias("half"), F.coalesce("positive", F.lit(False)).alias("positive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t or b"", spec.shapes).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "x", "half", "positive"])

    path = fresh_dir(spark, "features")
    schema = "doc_id long, x binary, half int, positive boolean"
    arrow_map(marked, run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, width)


def moments(table: DataFrame, spec: ClassifierSpec = ClassifierSpec()) -> dict[tuple[bool, int], Moments]:
    """Moments by (positive, half) of a feature table; all teaching rows are unlabelled text, the positives besides count as such."""
    width = N_STATS + spec.shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[tuple[bool, int], Moments] = {}
        for batch in batches:
            x, half, positive = _matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for h in (0, 1):
                for kind, own in ((False, half == h), (True, (half == h) & positive)):
                    if own.any():
                        sums[kind, h] = sums.get((kind, h), Moments.none(width)) + Moments.of(x[own])
        for (kind, h), m in sums.items():
            data = np.concatenate([m.first, m.second.ravel()]).tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "positive": [kind], "half": pa.array([h], pa.int32()), "n": pa.array([m.n], pa.int64()), "data": pa.array([data], pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x, np.float64) for x in rows.column("data").to_pylist()], axis=0).tobytes()
        return pa.table({"part": rows.column("part")[:1], "positive": rows.column("positive")[:1], "half": rows.column("half")[:1], "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "data": pa.array([data], pa.binary())})

    schema = "part int, positive boolean, half int, n long, data binary"
    parts = arrow_map(table.filter("half is not null").select("x", "half", "positive"), run, schema)
    # in two steps, so that no task gets the sums of all others
    bundles = parts.withColumn("part", F.col("part") % max(1, math.isqrt(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).groupBy("part", "positive", "half").applyInArrow(total, schema)
    out = {(p, h): Moments.none(width) for p in (False, True) for h in (0, 1)}
    for r in bundles.groupBy("positive", "half").applyInArrow(total, schema).collect():  # four rows at most
        sums = np.frombuffer(bytes(r["data"]), np.float64)
        out[r["positive"], r["half"]] = Moments(r["n"], sums[: width + 1], sums[width + 1 :].reshape(width + 1, width + 1))
    return out


def score_counts(table: DataFrame, model: Model, half: int, spec: ClassifierSpec = ClassifierSpec()) -> tuple[np.ndarray, np.ndarray]:
    """How many (positives, unlabelled texts) of a half have each of bins + 1 scores."""
    width = N_STATS + spec.shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, spec.bins + 1), np.int64)
        for batch in batches:
            at = np.round(model.scores(_matrix(batch.column(0), width)) * spec.bins).astype(np.int64)
            counts[0] += np.bincount(at, minlength=spec.bins + 1)
            counts[1] += np.bincount(at[batch.column(1).to_numpy(zero_copy_only=False)], minlength=spec.bins + 1)
        kind, score = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"positive": pa.array(kind, pa.int32()), "score": pa.array(score, pa.int32()), "n": pa.array(counts[kind, score])})

    found = arrow_map(table.filter(F.col("half") == half).select("x", "positive"), run, "positive int, score int, n long")
    counts = np.zeros((2, spec.bins + 1), np.int64)
    for r in found.groupBy("positive", "score").agg(F.sum("n").alias("n")).collect():  # two rows a bin at most
        counts[r["positive"], r["score"]] = r["n"]
    return counts[1], counts[0]


def train(table: DataFrame, spec: ClassifierSpec = ClassifierSpec()) -> Model:
    """Fit on all teaching rows of a feature table, with the prior that its second half shows."""
    sums = moments(table, spec)
    first = fit(sums[True, 0], sums[False, 0], spec.first_prior, spec)
    prior = best_bin_prior(*score_counts(table, first, 1, spec), spec.risk, spec.first_prior)
    return fit(sums[True, 0] + sums[True, 1], sums[False, 0] + sums[False, 1], prior, spec)


def score(table: DataFrame, model: Model, spec: ClassifierSpec = ClassifierSpec()) -> DataFrame:
    """(doc_id, score) for every row of a feature table."""
    width = N_STATS + spec.shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(_matrix(batch.column(1), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return arrow_map(table.select("doc_id", "x"), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, spec: ClassifierSpec = ClassifierSpec()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels of null or other quality, of the held-out fold, or without a document
    teach nothing; null and empty texts get the score of no words; repeated rows
    all get the same score; a null id is not held out.  Without positives or
    unlabelled texts every score is 0.5.
    """
    table = feature_table(docs, labels, spec)
    scored = score(table, train(table, spec), spec)
    held = F.coalesce(fold_of(F.col("doc_id"), spec.folds) == spec.held_out_fold, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= spec.threshold).cast("int").alias("predicted"))
