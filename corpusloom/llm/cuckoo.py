"""A cuckoo filter over 128-bit keys: look-ups and first places in bulk with numpy, moves and deletes one by one."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 500
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second half of keys given as bytes of shape (n, 16)."""
    both = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    """Holds a 16-bit mark of each key in one of two buckets of four slots.

    No false negatives as long as only inserted keys are deleted.  ``insert``
    returns False when no slot can be freed; the owner then builds a larger
    filter from its exact table.
    """

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized_for(cls, n: int) -> "CuckooFilter":
        """Empty, for n keys at a load of at most 0.84."""
        buckets = 1 << max(3, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.84)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> "CuckooFilter":
        n = len(hi)
        while True:
            made = cls.sized_for(n)
            if made.insert_many(hi, lo):
                return made
            n = len(made.table) * SLOTS

    def _fill(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets, as many as go in; returns which did."""
        order = np.argsort(at, kind="stable")
        own = at[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
        free = self.table[own] == 0
        fits = rank < free.sum(axis=1)
        nth = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        done = np.zeros(len(at), bool)
        done[order[fits]] = True
        self.table[own[fits], nth.argmax(axis=1)[fits]] = mark[order[fits]]
        return done

    def insert_many(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """All keys: into their first or second bucket where a slot is free, the others one by one; False when one finds none."""
        mark, a, b = self._places(hi, lo)
        left = np.flatnonzero(~self._fill(a, mark))
        left = left[~self._fill(b[left], mark[left])]
        return all(self.insert(int(hi[k]), int(lo[k])) for k in left)

    @classmethod
    def loads(cls, data: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (lo & np.uint64(0xFFFF)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = hi & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, at, mark):
        with np.errstate(over="ignore"):
            return at ^ (((np.uint64(mark) if np.isscalar(mark) else mark.astype(np.uint64)) * _MIX >> np.uint64(20)) & self.mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(hi, lo)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def _one(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark, a, b = self._places(np.array([hi], np.uint64), np.array([lo], np.uint64))
        return int(mark[0]), int(a[0]), int(b[0])

    def insert(self, hi: int, lo: int) -> bool:
        mark, a, b = self._one(hi, lo)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        moved, at = [], b
        for k in range(MAX_KICKS):
            slot = (k * 7 + mark) % SLOTS
            moved.append((at, slot, int(self.table[at, slot])))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = int(self._other(np.array([at], np.uint64), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot, was in reversed(moved):
            self.table[at, slot] = was
        return False

    def delete(self, hi: int, lo: int) -> bool:
        mark, a, b = self._one(hi, lo)
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False
