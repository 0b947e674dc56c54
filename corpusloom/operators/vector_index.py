"""A stored vector index: cells around centres, pruned by bounds, with an exact way.

The centres are fitted on a bounded sample (``sample`` rows, those of the smallest
hash of their id), once; every row is assigned to its nearest centre and stored
under ``vectors/version=v/cell=c`` as a unit vector.  Each version also keeps how
far a cell's rows lie from its centre at most, so with a the angle of a query to the
centre and r that of the farthest row, no row of the cell has a cosine above
cos(max(0, a - r)).

A search takes a query's nearest ``probes`` cells; the number is chosen when the
centres are fitted, as the least that finds ``recall`` of the true neighbours of
sampled rows within the sample.  The exact way then also opens every cell whose
bound reaches the k-th score found, so its rows are those of `similarity.nearest`.
Cells that no query of a block needs are not read.

Rows with a null id or vector, or a null or non-finite component, take no part; ids
that are there already are not inserted again, and an id stands once (least vector).
All vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.operators import similarity as S
from corpusloom.session import cut
from corpusloom.shipping import ship
from corpusloom.sources import tables as T

_STATS = "version int, cell int, n long, least double"
SLACK = 2e-6  # scores are rounded to six places


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell takes the row that lies farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 500) -> int:
    """The least number of cells that holds `recall` of the k nearest rows of the first `queries` rows of the sample."""
    asked = sample[:queries]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each cell, by a query
    cell = (sample @ centres.T).argmax(axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1)
    shares = np.cumsum(np.bincount(needed.ravel(), minlength=len(centres))) / needed.size
    return int(np.searchsorted(shares, recall) + 1) if shares[-1] >= recall else len(centres)


class VectorIndex:
    """root: a folder that the driver and all executors share; cells: about the square root of the first insert's rows if not given, 4096 at most; sample: rows that the centres are fitted on."""

    def __init__(self, spark: SparkSession, root: str, cells: int | None = None, sample: int = 20_000, recall: float = 0.97, k: int = 10, id_type: str = "long"):
        self.spark, self.root, self.cells, self.sample, self.recall_wanted, self.k = spark, root.rstrip("/"), cells, sample, recall, k
        self.schema = f"vec_id {id_type}, v array<double>, cell int"
        self.id_type = id_type

    def versions(self) -> list[int]:
        return T.versions(self.spark, f"{self.root}/stats")

    def vectors(self) -> DataFrame:
        """(vec_id, v, cell) of all versions; a filter on cell reads those folders alone."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        folder = f"{self.root}/vectors"
        return self.spark.read.schema(self.schema).option("basePath", folder).parquet(*[f"{folder}/version={v}" for v in known]).select("vec_id", "v", "cell")

    def centres(self) -> tuple[np.ndarray, int]:
        """(centres, probes); a row a cell reaches the driver, 4096 at most."""
        rows = T.read_version(self.spark, f"{self.root}/centres", "cell int, centre array<double>, probes int").orderBy("cell").toArrow().combine_chunks()
        return _matrix(rows.column("centre").combine_chunks()), rows.column("probes")[0].as_py()

    def _sound(self, rows: DataFrame) -> DataFrame:
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        doubles = rows.filter("vec_id is not null and v is not null").select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v")).filter(~F.exists("v", bad))
        return doubles.groupBy("vec_id").agg(F.min("v").alias("v"))

    def _fit(self, rows: DataFrame) -> None:
        """Fit centres and probes on a bounded sample, and write them."""
        n = rows.count()
        cells = self.cells or max(1, min(4096, round(n**0.5)))
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(self.sample).select("v").toArrow().combine_chunks()
        sample = _unit(_matrix(picked.column("v").combine_chunks()))
        centres = fit_centres(sample, cells)
        probes = fit_probes(sample, centres, self.k, self.recall_wanted)
        kept = [(i, c.tolist(), probes) for i, c in enumerate(centres)]
        T.write_version(self.spark.createDataFrame(kept, "cell int, centre array<double>, probes int"), f"{self.root}/centres")

    def insert(self, rows: DataFrame) -> int:
        """Add rows(vec_id, v) that are not there yet; returns the version, or the last one if nothing is new."""
        known = self.versions()
        new = self._sound(rows)
        if known:
            new = new.join(self.vectors().select("vec_id"), "vec_id", "left_anti")
        new = cut(new)
        if new.isEmpty():
            return (known or [0])[-1]
        if not known:
            self._fit(new)
        number = (known or [0])[-1] + 1
        sent = self.spark.sparkContext.broadcast(self.centres()[0])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _unit(_matrix(batch.column(1)))
                near = v @ sent.value.T
                ends = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                own = near.argmax(axis=1)
                cols = [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel())), pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(v)), own])]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cell", "near"])

        ship(self.spark)
        placed = cut(new.select("vec_id", "v").mapInArrow(assign, f"{self.schema}, near double"))
        ordered = placed.drop("near").repartitionByRange("cell", "vec_id")  # few files a cell, and a large cell over several tasks
        ordered.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors/version={number}")
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least")).select(F.lit(number).alias("version"), "cell", "n", "least")
        if (written := T.write_version(stats, f"{self.root}/stats")) != number:
            raise RuntimeError(f"version {number} was written as {written}: one insert at a time")
        return number

    def _scan(self, asked: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """(at, vec_id, score): each task's k best rows of the cells that each row of `asked` wants; ties by vec_id."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        sent = self.spark.sparkContext.broadcast((asked, wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_, wanted_ = sent.value
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, v = batch.column(2).to_numpy(), _matrix(batch.column(1))
                for c in np.unique(cell).tolist():
                    rows, at = np.flatnonzero(cell == c), np.flatnonzero(wanted_[:, c])
                    for part in range(0, len(at), 512):
                        own = at[part : part + 512]
                        score = np.round(asked_[own] @ v[rows].T, 6)
                        ids = batch.column(0).take(pa.array(np.tile(rows, len(own))))
                        found = pa.table({"at": np.repeat(own, len(rows)), "vec_id": ids, "score": score.ravel()})
                        best = _best(found if best is None else pa.concat_tables([best, found]), k)
            if best is not None:
                yield from best.combine_chunks().to_batches()

        ship(self.spark)
        return self.vectors().filter(F.col("cell").isin(cells)).mapInArrow(run, f"at long, vec_id {self.id_type}, score double")

    def search(self, queries: DataFrame, k: int, exact: bool = False, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): the k most similar vectors of each of queries(query_id, q) by the score rounded to six places, ties by vec_id."""
        kind = dict(queries.dtypes)["query_id"]
        none = self.spark.createDataFrame([], f"query_id {kind}, vec_id {self.id_type}, score double, rank int")
        if not self.versions():
            return none
        centres, fitted = self.centres()
        probes = min(len(centres), probes or fitted)
        stats = T.read_appended(self.spark, f"{self.root}/stats", _STATS).groupBy("cell").agg(F.min("least").alias("least")).toArrow()  # a row a cell
        reach = np.full(len(centres), np.nan)
        reach[stats.column("cell").to_numpy()] = np.arccos(np.clip(stats.column("least").to_numpy() - 1e-9, -1, 1))
        order = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = none
        sound = queries.filter("query_id is not null and q is not null").select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
        for part in S.query_blocks(sound, "query_id"):
            block = part.toArrow().combine_chunks()
            if not block.num_rows:
                continue
            asked = _unit(_matrix(block.column("q").combine_chunks()))
            near = asked @ centres.T
            wanted = np.zeros(near.shape, bool)
            np.put_along_axis(wanted, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
            wanted &= ~np.isnan(reach)
            found = ranked(self._scan(asked, wanted, k))
            if exact:
                found = cut(found)
                last = found.filter(F.col("rank") == k).select("at", "score").toArrow()  # a row a query of the block
                least = np.full(len(asked), -np.inf)
                least[last.column("at").to_numpy()] = last.column("score").to_numpy()
                angle = np.arccos(np.clip(near, -1, 1)) - np.nan_to_num(reach)
                more = (np.cos(np.maximum(0.0, angle)) + SLACK >= least[:, None]) & ~wanted & ~np.isnan(reach)
                self.opened = int((wanted | more).sum())
                found = ranked(found.drop("rank").unionByName(self._scan(asked, more, k)))
            names = self.spark.createDataFrame(pa.table({"at": np.arange(len(asked)), "query_id": block.column("query_id")}))
            out = out.unionByName(found.join(F.broadcast(names), "at").select("query_id", "vec_id", "score", "rank"))  # a block of queries
        return out

    def recall(self, queries: DataFrame, k: int) -> float:
        """The share of the true neighbours of the queries that a search finds."""
        true, found = self.search(queries, k, exact=True), self.search(queries, k)
        met = true.join(found, ["query_id", "vec_id"], "left_semi").count()
        return met / max(1, true.count())


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k rows of the highest score of each `at`, ties by vec_id."""
    found = found.sort_by([("at", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
    at = found.column("at").to_numpy()
    return found.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < k))
