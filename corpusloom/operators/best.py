"""The k best rows of every query within one task, so that a search moves k rows a query and task instead of all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores (rows times queries) that a task holds at once, about.
CELLS = 1 << 21


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    """x rounded, halves away from zero, as SQL rounds."""
    scale = 10.0**places
    with np.errstate(invalid="ignore"):
        return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x) + 0.0


class Best:
    """The k best of each of n queries by rounded score, ties by id; -inf stands for a score that is null, NaN is above all.

    Rows that reach a query's k-th score are put aside and settled once there are
    as many as results, so a row that comes too late costs one comparison a query.
    """

    def __init__(self, n: int, k: int, places: int):
        self.n, self.k, self.places = n, k, places
        self.floor = np.full(n, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting, self.most = 0, max(n * k, 1 << 16)

    def add(self, scores: np.ndarray, ids: pa.Array, least: float | None = None) -> None:
        """scores: a row for each of ids, a column a query; below `least` (rounded) a row doesn't count."""
        near = ~(scores < self.floor - 2 * 10.0**-self.places)  # NaN stays
        if least is not None:
            near &= scores >= least - 0.6 * 10.0**-self.places
        row, query = np.nonzero(near)
        if not len(row):
            return
        score = half_up(scores[row, query], self.places)
        sure = ~(score < self.floor[query])
        if least is not None:
            sure &= score >= least
        row, query, score = row[sure], query[sure], score[sure]
        self.kept.append((query, score, ids.take(pa.array(row))))
        self.waiting += len(row)
        if self.waiting > self.most:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        query, score = (np.concatenate([x[i] for x in self.kept]) for i in (0, 1))
        ids = pa.concat_arrays([x[2] for x in self.kept])
        place = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, np.where(np.isnan(score), -np.inf, -score), query))
        first = np.searchsorted(query[order], np.arange(self.n))
        rank = np.arange(len(order)) - first[query[order]]
        order = order[rank < self.k]
        query, score, ids = query[order], score[order], ids.take(pa.array(order))
        last = rank[rank < self.k] == self.k - 1
        self.floor[query[last]] = score[last]
        self.kept, self.waiting = [(query, score, ids)], 0

    def rows(self, names: list[str], queries: pa.Array, most: int = 10_000):
        """Batches (query, id, score) of what is left."""
        self.settle()
        for query, score, ids in self.kept:
            for at in range(0, len(query), most):
                part = slice(at, at + most)
                value = pa.array(score[part], mask=np.isneginf(score[part]))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(query[part])), ids[part], value], names=names)
