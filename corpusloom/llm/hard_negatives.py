"""Hard negatives by integer inner products, with an orthogonal rotation that discards early.

Components become the integers floor(scale * x), and a pair's score is the exact
integer inner product.  A rotation to principal axes, fitted on the second moments
of all rows, changes no inner product; after the leading axes

    |score - partial product| <= residual norm * residual norm + rounding slack

by Cauchy and Schwarz, so a pair whose bound stays below what it would have to
reach is discarded after few axes.  What survives all levels is multiplied out in
integers, and only that decides.

Anchors are taken in blocks of about ``block`` rows, each broadcast; every task
takes the rows it reads against a block in matrices and keeps its own best, so a
label of any share of the rows is spread over all tasks, and what is shuffled is a
few rows an anchor and task.  One pass finds an anchor's positives, the next its
negatives in the band of each positive.  Each block's result is written before the
next begins.

Case by case: rows with a null id, label or vector, or a null or non-finite component,
take no part; vectors of unequal length are filled up with zeros, an empty one has
product 0; a positive's score below zero has an empty band; repeated rows count as
often as they stand, but rows with an anchor's own id are never its positives, and
an anchor's id is taken once (least label and vector); integers and scores beyond
64 bits stop at the ends of that range; an empty table or one without anchors gives
no rows; columns are taken by name, others are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.workspace import arrow_map, cut, fresh_dir, spread


@dataclass(frozen=True)
class NegativeSpec:
    """scale: of components; positives, negatives: rows kept; low, high: percent of a positive's score that a negative has; block: anchors sent to all tasks at once; rows: of the corpus in a matrix; levels: shares of the axes after which pairs are discarded."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block: int = 2_000
    rows: int = 1_024
    levels: tuple[float, ...] = (0.125, 0.25, 0.5)


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _integers(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as integers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    sound = rows.filter("vec_id is not null and label is not null and embedding is not null").select("vec_id", "label", doubles.alias("d")).filter(~F.exists("d", bad))
    return sound.select("vec_id", "label", F.transform("d", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of at least `width`, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def rotation(vectors: DataFrame) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of all vectors(v), the strongest first; 0 x 0 without vectors.

    Tasks add up products; sums by pair of axes are combined in a shuffle, so width squared numbers reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            x = _matrix(batch.column(0), len(total)).astype(np.float64)
            if x.shape[1] > len(total):
                total = np.pad(total, (0, x.shape[1] - len(total)))
            total += x.T @ x
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    sums = arrow_map(vectors.select("v"), moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    if not sums.num_rows:
        return np.zeros((0, 0))
    i, j, s = (sums.column(c).to_numpy() for c in ("i", "j", "s"))
    whole = np.zeros((int(j.max()) + 1,) * 2)
    whole[i, j] = whole[j, i] = s
    return np.linalg.eigh(whole / max(1.0, np.abs(whole).max()))[1][:, ::-1].copy()


class Rows:
    """Ids, labels and integer vectors of some rows, rotated, with residual norms after each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, axes: np.ndarray, levels: tuple[float, ...]):
        self.ids, self.labels = ids, labels
        self.ints = ints if ints.shape[1] == len(axes) else np.pad(ints, ((0, 0), (0, len(axes) - ints.shape[1])))
        self.turned = self.ints.astype(np.float64) @ axes
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.norms = np.sqrt(squares[:, 0]) if len(axes) else np.zeros(len(ids))
        self.ends = sorted({max(1, min(len(axes), math.ceil(len(axes) * x))) for x in levels}) if len(axes) else [0]
        self.left = [np.sqrt(squares[:, e]) if e < len(axes) else np.zeros(len(ids)) for e in self.ends]

    @classmethod
    def of(cls, batch: pa.RecordBatch, axes: np.ndarray, levels: tuple[float, ...]) -> "Rows":
        return cls(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), len(axes)), axes, levels)


def _slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """More than rounding can have moved a product of rows of these norms, in the rotation or in the sums."""
    return 1e-9 * a * b + 1e-6


def products(a: Rows, at: np.ndarray, b: Rows, bt: np.ndarray) -> np.ndarray:
    """Exact integer products of the pairs of rows; in Python's integers where 64 bits might not do."""
    out = np.einsum("ij,ij->i", a.ints[at], b.ints[bt])
    for i in np.flatnonzero(a.norms[at] * b.norms[bt] >= 2.0**62):
        exact = sum(x * y for x, y in zip(a.ints[at[i]].tolist(), b.ints[bt[i]].tolist(), strict=True))
        out[i] = min(max(exact, _LEAST), _MOST)
    return out


def survivors(a: Rows, b: Rows, pairs: np.ndarray, reach, part: int = 32_768) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, exact score) of those `pairs` (a matrix of truth) that no level discards.

    reach(rows of a, lower, upper) says which pairs' bounds leave them a chance.
    """
    end = a.ends[0]
    near = a.turned[:, :end] @ b.turned[:, :end].T
    room = a.left[0][:, None] * b.left[0][None, :] + _slack(a.norms[:, None], b.norms[None, :])
    at, bt = np.nonzero(pairs & reach(slice(None), near - room, near + room))
    found = []
    for k in range(0, len(at), part):  # few pairs at once, so that their rows fit in memory
        i, j = at[k : k + part], bt[k : k + part]
        s, done = near[i, j], end
        for level, to in enumerate(a.ends[1:], 1):
            s = s + np.einsum("ij,ij->i", a.turned[i, done:to], b.turned[j, done:to])
            room_ = a.left[level][i] * b.left[level][j] + _slack(a.norms[i], b.norms[j])
            keep = reach(i, s - room_, s + room_)
            i, j, s, done = i[keep], j[keep], s[keep], to
        found.append((i, j, products(a, i, b, j)))
    if not found:
        return at, bt, np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Best:
    """The k best (score, id) of each of n lists, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)  # what a new score must reach

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.append(self.key, key), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, ~score, key))  # ~ turns the order around and can't overflow
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.k
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        last = place[kept] == self.k - 1
        self.least[self.key[last]] = self.score[last]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, the first ones smaller, so that there is something to reach early."""
    size = max(1, rows // 16)
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, size)
            at, size = at + size, rows


def _positives(corpus: DataFrame, sent, axes, spec: NegativeSpec) -> DataFrame:
    """(a, vec_id, score): each task's best rows of the same label for row a of the sent anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Rows = sent.value
        best = Best(len(anchors.ids), spec.positives)
        for chunk in _chunks(batches, spec.rows):
            part = Rows.of(chunk, axes.value, spec.levels)
            pairs = (anchors.labels[:, None] == part.labels[None, :]) & (anchors.ids[:, None] != part.ids[None, :])
            reach = lambda i, lower, upper: upper >= (best.least[i] if lower.ndim == 1 else best.least[:, None])  # noqa: B023, E731
            i, j, score = survivors(anchors, part, pairs, reach)
            best.add(i, score, part.ids[j])
        yield pa.RecordBatch.from_pydict({"a": best.key, "vec_id": best.id, "score": best.score})

    return arrow_map(corpus, run, "a long, vec_id long, score long")


def _negatives(corpus: DataFrame, sent, axes, bands, spec: NegativeSpec) -> DataFrame:
    """(pair, vec_id, score): each task's best rows of another label in the band of each pair of an anchor and a positive; pair = row of the anchor * positives + place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Rows = sent.value
        low, high = bands.value  # anchors x positives; an empty band has low > high
        width = low.shape[1]
        best = Best(low.size, spec.negatives)

        def reach(i, lower, upper):
            least = np.maximum(low.astype(np.float64), best.least.reshape(low.shape))[i]
            most = high.astype(np.float64)[i]
            found = np.zeros(lower.shape, bool)
            for p in range(width):
                floor, ceiling = (least[:, p, None], most[:, p, None]) if lower.ndim == 2 else (least[:, p], most[:, p])
                found |= (upper >= floor) & (lower <= ceiling) & (floor <= ceiling)
            return found

        for chunk in _chunks(batches, spec.rows):
            part = Rows.of(chunk, axes.value, spec.levels)
            i, j, score = survivors(anchors, part, anchors.labels[:, None] != part.labels[None, :], reach)
            for p in range(width):
                own = (score >= low[i, p]) & (score <= high[i, p])
                best.add(i[own] * width + p, score[own], part.ids[j[own]])
        yield pa.RecordBatch.from_pydict({"pair": best.key, "vec_id": best.id, "score": best.score})

    return arrow_map(corpus, run, "pair long, vec_id long, score long")


def _ranked(found: DataFrame, key: str, most: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def band(score: int, spec: NegativeSpec) -> tuple[int, int]:
    """Least and greatest integer score s with low * score <= 100 * s <= high * score."""
    return -(-spec.low * score // 100), spec.high * score // 100


def hard_negatives(rows: DataFrame, is_anchor: Column, spec: NegativeSpec = NegativeSpec()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows(vec_id, label, embedding), ids and labels whole numbers.

    An anchor's positives are its best rows of the same label, a positive's
    negatives the best rows of other labels whose score is between low and high
    percent of the positive's.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    corpus = spread(_integers(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding"), spec.scale))
    turn = rotation(corpus)
    axes = context.broadcast(turn)
    anchors = cut(corpus.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))
    blocks = max(1, -(-anchors.count() // spec.block))
    folder = fresh_dir(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(blocks):
        table = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow().combine_chunks()  # about spec.block rows
        if not table.num_rows:
            continue
        block = Rows.of(table.to_batches()[0], turn, spec.levels)
        sent = context.broadcast(block)
        best = _ranked(_positives(corpus, sent, axes, spec), "a", spec.positives).toArrow()  # spec.positives rows an anchor of the block
        a, place, ids, scores = (best.column(c).to_numpy() for c in ("a", "rank", "vec_id", "score"))
        low, high = np.full((len(block.ids), spec.positives), 1), np.zeros((len(block.ids), spec.positives), np.int64)
        for i, p, s in zip(a.tolist(), place.tolist(), scores.tolist(), strict=True):
            low[i, p - 1], high[i, p - 1] = band(s, spec)
        bands = context.broadcast((low, high))
        kept = _ranked(_negatives(corpus, sent, axes, bands, spec), "pair", spec.negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        pairs = pa.table({"pair": a * spec.positives + place - 1, "anchor_id": block.ids[a], "positive_id": ids, "positive_score": scores})
        named = F.broadcast(spark.createDataFrame(pairs))  # the block's anchors with their positives
        kept.join(named, "pair").select(*[f.split()[0] for f in schema.split(", ")]).write.parquet(f"{folder}/block={b}")
        for used in (sent, bands):
            used.unpersist()
    if not blocks or not anchors.take(1):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, block int").parquet(folder).drop("block")
