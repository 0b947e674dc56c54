"""Groups of near copies by similarity: SimHash with deletion variants, in two fingerprints.

Two texts whose five-word shingles have a similarity (Jaccard) of 0.8 differ in
about one word of forty, so their five-word SimHash differs in 15 % of its bits:
too many to index by.  A SimHash of word pairs differs in 9 % there, and is the
index: it is cut into segments, every segment is filed once for each of its bits
with that bit wiped, and texts that agree in some segment but for at most one
bit meet; so do all that differ in fewer than twice as many bits as there are
segments.  Those that meet are linked where the 128 bits of the five-word
SimHash are within ``most_bits``, as 19 of them differ on average at a
similarity of 0.8, 30 at 0.6 and 64 for unrelated texts.

Segments are the same for every table, so whether two texts are linked follows
from these two alone.  The more rows, the more of them meet by chance; such
meetings cost a comparison each and no row of the result.

Exact copies collapse to one fingerprint first.  A group of texts under one
variant is searched so that it emits one edge a member at most.  Variants that
can hold over ``split_at`` fingerprints are found by counts of whole segments
before anything is gathered, and searched in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.vocab import trim
from corpusloom.llm.workspace import arrow_map, cut, slices

LINK_WORDS = 2
_ODD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of each byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


@dataclass(frozen=True)
class CopySpec:
    """segments of segment_bits (31 at most) each index a text; most_bits of 128 link; split_at: members of a variant before it is searched in blocks; compare_at: members up to which all pairs of a group are compared at once; max_words: whose hashes a task remembers."""

    index_shingle: int = 2
    segments: int = 12
    segment_bits: int = 16
    link_shingle: int = 5
    most_bits: int = 26
    split_at: int = 50_000
    compare_at: int = 1024
    max_words: int = 200_000
    broadcast_rows: int = 100_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, of the whole text if it is shorter."""
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = _mixed(out * _ODD + words[k : len(words) - n + 1 + k])
    return out


def _majority(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Which of 64 * n_words bits are set in over half of the hashes, each stretched to that many."""
    steps = (np.arange(1, n_words + 1, dtype=np.uint64) * _ODD)[None, :]
    offsets = np.arange(8 * n_words) * 256
    counts = np.zeros(8 * n_words * 256, np.int64)
    for k in range(0, len(hashes), 4096):
        wide = _mixed(hashes[k : k + 4096, None] + steps)
        counts += np.bincount((wide.view(np.uint8).reshape(len(wide), -1) + offsets).ravel(), minlength=len(counts))
    return (counts.reshape(-1, 256).astype(np.float64) @ _BITS).ravel() * 2 > len(hashes)


def prints(words: np.ndarray, spec: CopySpec) -> tuple[np.ndarray, np.ndarray]:
    """(segments, two link words) of a text given by the hashes of its words; zeros for no words."""
    if not len(words):
        return np.zeros(spec.segments, np.int64), np.zeros(LINK_WORDS, np.uint64)
    n_bits = spec.segments * spec.segment_bits
    with np.errstate(over="ignore"):
        index = _majority(_shingles(words, spec.index_shingle), -(-n_bits // 64))[:n_bits]
        link = _majority(_shingles(words, spec.link_shingle), LINK_WORDS)
    return index.reshape(spec.segments, -1) @ (1 << np.arange(spec.segment_bits)), np.packbits(link, bitorder="little").view(np.uint64)


def node_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The name of a link fingerprint, as a signed number."""
    with np.errstate(over="ignore"):
        return _mixed(first * _ODD + second).view(np.int64)


def copy_prints(docs: DataFrame, spec: CopySpec = CopySpec()) -> DataFrame:
    """(doc_id, text_key, node, w0, w1, segments) for every row of docs(doc_id, text, ...); a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64()), ("segments", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches):
            segments, link = [], np.zeros((batch.num_rows, LINK_WORDS), np.uint64)
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").lower().split()
                if len(known) > spec.max_words:
                    known = {}
                for w in words:
                    if w not in known:
                        known[w] = digest(w, 42)
                own, link[i] = prints(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), spec)
                segments.append(own)
            w0, w1 = np.ascontiguousarray(link[:, 0]), np.ascontiguousarray(link[:, 1])
            ends = np.arange(len(segments) + 1, dtype=np.int32) * spec.segments
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(segments).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), *[pa.array(x) for x in (node_of(w0, w1), w0.view(np.int64), w1.view(np.int64))], listed], schema=schema)
        known.clear()
        trim()

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, text_key long, node long, w0 long, w1 long, segments array<int>")


def linked(w0: np.ndarray, w1: np.ndarray, starts: np.ndarray, most_bits: int, compare_at: int) -> np.ndarray:
    """Which rows are close to another one of their group; all rows of groups of over compare_at."""
    sizes = np.diff(np.append(starts, len(w0)))
    out = np.repeat(sizes > compare_at, sizes)
    after = np.where(out, 0, np.repeat(starts + sizes - 1, sizes) - np.arange(len(w0)))  # members behind a row
    at, n = np.arange(len(w0)), np.bincount(after)[::-1].cumsum()[::-1]
    for k in range(1, len(n)):
        if 4 * n[k] > len(w0):  # most rows have a k-th next one: slices are faster than places
            few = np.flatnonzero(np.bitwise_count(w0[:-k] ^ w0[k:]) <= most_bits)
            few = few[after[few] >= k]
        else:
            at = at[after[at] >= k]
            few = at[np.bitwise_count(w0[at] ^ w0[at + k]) <= most_bits]
        near = few[np.bitwise_count(w0[few] ^ w0[few + k]).astype(np.int16) + np.bitwise_count(w1[few] ^ w1[few + k]) <= most_bits]
        out[near] = out[near + k] = True
    return out


def search(w0: np.ndarray, w1: np.ndarray, most_bits: int) -> list[tuple[np.ndarray, int]]:
    """Spanning edges of the links in one group, as places: [(members, the member that reached them)]."""
    found, left = [], np.arange(len(w0))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            ok = np.bitwise_count(w0[left] ^ w0[at]).astype(np.int16) + np.bitwise_count(w1[left] ^ w1[at]) <= most_bits
            if ok.any():
                found.append((left[ok], at))
                queue.extend(left[ok].tolist())
                left = left[~ok]
    return found


def _link(rows: DataFrame, keys: list[str], spec: CopySpec) -> DataFrame:
    """Edges (u, v) of nodes inside groups of equal keys; rows(keys..., w0, w1) come sorted by keys within partitions."""

    most_bits = spec.most_bits

    def edges(w0: np.ndarray, w1: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        stay = linked(w0, w1, starts, most_bits, spec.compare_at)
        sizes = np.add.reduceat(stay, starts, dtype=np.int64)
        w0, w1, sizes = w0[stay], w1[stay], sizes[sizes > 0]
        starts = np.cumsum(sizes) - sizes
        two = starts[sizes == 2]  # most groups
        near = two[np.bitwise_count(w0[two] ^ w0[two + 1]).astype(np.int16) + np.bitwise_count(w1[two] ^ w1[two + 1]) <= most_bits]
        us, vs = [near + 1], [near]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for members, at in search(w0[a : a + n], w1[a : a + n], most_bits):
                us.append(members + a)
                vs.append(np.full(len(members), at + a))
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack([node_of(w0[u], w1[u]), node_of(w0[v], w1[v])], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys) + 2)])
            if sum(len(x[0]) for x in held) < 100_000:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[: len(keys)]], axis=0)) + 1
            if not len(changed):
                held = [columns]
                continue
            end = changed[-1]  # the last group may go on in the next batch
            yield edges(*[np.ascontiguousarray(c[:end]).view(np.uint64) for c in columns[-2:]], np.concatenate(([0], changed[:-1])))
            held = [[c[end:] for c in columns]]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[: len(keys)]], axis=0)) + 1
            yield edges(*[np.ascontiguousarray(c).view(np.uint64) for c in columns[-2:]], np.concatenate(([0], changed)))

    return arrow_map(rows.select(*keys, "w0", "w1"), run, "u long, v long")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter("n > 1").drop("n")


def copy_links(distinct: DataFrame, spec: CopySpec = CopySpec()) -> DataFrame:
    """Edges (u, v) of the nodes of distinct(w0, w1, segments) that meet and are close."""
    bits = spec.segment_bits

    def variant(segment: str, value: str, bit: str):
        return F.expr(f"shiftleft(cast({segment} * {bits} + {bit} as bigint), {bits}) + ({value} & ~shiftleft(1, {bit}))").alias("key")

    values = distinct.select(F.posexplode("segments").alias("segment", "value"))
    heavy = cut(values.groupBy("segment", "value").count().filter(F.col("count") > spec.split_at // 2))
    rows = distinct.select("w0", "w1", "segments", F.explode(F.sequence(F.lit(0), F.lit(spec.segments * bits - 1))).alias("t")).select(variant(f"(t div {bits})", f"get(segments, cast(t div {bits} as int))", f"cast(t % {bits} as int)"), "w0", "w1")
    n = heavy.count()
    if not n:
        return _link(_grouped(rows, ["key"]), ["key"], spec)
    listed = heavy.select("segment", "value", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b")).select(variant("segment", "value", "b")).distinct()
    if n <= spec.broadcast_rows:
        listed = F.broadcast(listed)
    light, large = rows.join(listed, "key", "left_anti"), cut(rows.join(listed, "key", "left_semi"))
    sizes = large.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / F.lit(spec.split_at)).cast("long").alias("blocks"))
    placed = large.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("w0", "w1"), F.col("blocks"))).select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    parted = placed.select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), "w0", "w1")
    return _link(_grouped(light, ["key"]), ["key"], spec).unionByName(_link(_grouped(parted, ["key", "pair"]), ["key", "pair"], spec))


def bits_for(rows: int) -> int:
    """Bits of a segment with which as many texts meet by chance whatever the number of rows (up to 2 ** 24).

    For a CopySpec of one's own; near_copies never takes it by itself, as longer
    segments lose links: which are found would depend on the size of the table.
    """
    return min(31, 7 + max(1, (max(1, rows) - 1).bit_length()))


def near_copies(docs: DataFrame, spec: CopySpec = CopySpec()) -> DataFrame:
    """(doc_id, text_key, root) for every row of docs(doc_id, text, ...); rows of one root are one group.

    Copies of equal words always are one group.  Null and wordless texts are one
    group too; equal rows all stay; rows of a null doc_id take part.  Texts of
    fewer words than a shingle have the whole text as their only one.  An empty
    table gives no rows; other columns are ignored.
    """
    found = cut(copy_prints(docs, spec))
    distinct = cut(found.select("w0", "w1", "segments").distinct())
    roots = connected_components(copy_links(distinct, spec))
    labels = cut(roots.select("node", "root"))
    return found.select("doc_id", "text_key", "node").join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))
