"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than a plain pigeonhole split
needs, so that two fingerprints within ``max_bits`` agree in some segment but
for at most one bit.  Every fingerprint is indexed once for each bit of each
segment, with that bit wiped; two fingerprints within reach then share at least
one such one-wildcard variant.  Fingerprints that meet under a variant are
verified by the popcount of their difference, and only links that hold become
edges.

Hot groups: exact copies collapse to one fingerprint before anything is
indexed.  Fingerprints under one variant are linked by a search that drops what
it has reached, so it emits at most one edge a member, never all pairs.
Variants that can hold over ``split_at`` fingerprints are known beforehand from
counts of whole segments, which combine before their shuffle; those are never
gathered, but cut again by the same scheme on the remaining bits.  What is
still too large then is searched in pairs of blocks of ``split_at``.

``near_copies`` is for a wider reach, where similarity and not a number of bits
is asked for: texts are indexed by a fingerprint of word pairs, which differs
less than one of longer shingles, cut into segments with one wildcard, and
linked where fingerprints of five-word shingles are as close as those of texts
with a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.workspace import arrow_map, cut

WIDTH = 64
SEED = 42


@dataclass(frozen=True)
class SimHashSpec:
    """shingle: words a shingle; max_bits: differing bits that still link; split_at: members of a variant before it is cut again; broadcast_rows: large segment values that may be sent to every task."""

    shingle: int = 4
    max_bits: int = 4
    split_at: int = 50_000
    broadcast_rows: int = 100_000


def segments(bits: list[int], max_bits: int) -> list[list[int]]:
    """The fewest near-equal cuts of these bit positions of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned SimHash of one text; no words give 0."""
    words = text.lower().split()  # of bytes: A-Z only, and split at \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        grams = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams))
    counts = np.zeros(WIDTH, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """(doc_id, text_key, fp) for every row of docs(doc_id, text, ...); a null text has no words, text_key is its xxhash64."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            fps = np.zeros(batch.num_rows, np.uint64)
            for i in range(batch.num_rows):
                fps[i] = fingerprint(text[i].as_py() or b"", spec.shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps.view(np.int64))], schema=schema)

    return arrow_map(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, "doc_id long, text_key long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _edges_of_group(fps: np.ndarray, tag: int, cuts: list[list[int]], max_bits: int) -> list[tuple[np.ndarray, np.uint64]]:
    """Spanning edges of the links that have this variant as their first: [(members, the member that reached them)]."""
    earlier = []
    for segment in cuts:
        mask = np.uint64(sum(1 << b for b in segment))
        if tag in segment:
            own, any_bit = mask, segment[0] == tag
            break
        earlier.append(mask)
    found, left = [], fps
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            x = left ^ at
            ok = np.bitwise_count(x) <= max_bits
            if not any_bit:
                ok &= (x & own) != 0
            for mask in earlier:
                ok &= np.bitwise_count(x & mask) >= 2
            if ok.any():
                found.append((left[ok], at))
                queue.extend(left[ok])
                left = left[~ok]
    return found


def _link(rows: DataFrame, keys: list[str], bits_of: dict | None, max_bits: int) -> DataFrame:
    """Edges inside groups of equal keys; rows(keys..., fp) come sorted by keys within partitions.

    bits_of maps an outer tag to the bits cut for the inner one (None: one level).
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(group: np.ndarray, tags: tuple[int, ...]) -> list[tuple[np.ndarray, np.uint64]]:
        bits = list(range(WIDTH)) if bits_of is None else bits_of[tags[0]]
        return _edges_of_group(np.unique(group), tags[-1], segments(bits, max_bits), max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))]
            fps = batch.column(len(keys)).to_numpy(zero_copy_only=False).view(np.uint64)
            change = np.zeros(len(fps), bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], len(fps))
            us, vs = [], []

            def keep(found):
                for members, at in found:
                    us.append(members)
                    vs.append(np.full(len(members), at, np.uint64))

            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                key = tuple(int(c[a]) for c in columns)
                if key != held_key:
                    if held_key is not None:
                        keep(emit(np.concatenate(held), held_key[:1] if bits_of is None else (held_key[0], held_key[2])))
                    held_key, held = key, []
                held.append(fps[a:b])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], schema=schema)
        if held_key is not None:
            found = emit(np.concatenate(held), held_key[:1] if bits_of is None else (held_key[0], held_key[2]))
            if found:
                u = np.concatenate([m for m, _ in found]).view(np.int64)
                v = np.concatenate([np.full(len(m), at, np.uint64) for m, at in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return arrow_map(rows.select(*keys, "fp"), run, "u long, v long")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of two or more, in one exchange, in order within partitions; the caller has taken large groups out."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter("n > 1").drop("n")


def _by_tag(bits: Column | None, max_bits: int, make: Callable[[list[list[int]]], Column]) -> Column:
    """make(segments) over all bits, or over those that the outer tag leaves."""
    every = list(range(WIDTH))
    if bits is None:
        return make(segments(every, max_bits))
    out = F.lit(None)
    for own in segments(every, max_bits):
        out = F.when(bits.isin(own), make(segments([x for x in every if x not in own], max_bits))).otherwise(out)
    return out


def _variants(cuts: list[list[int]]) -> Column:
    """array<struct<tag, key>> of fp: a segment with one bit wiped, for each bit; the tag is that bit."""
    return F.array(*[F.struct(F.lit(b).cast("tinyint").alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << y for y in x) & ~(1 << b)))).alias("key")) for x in cuts for b in x])


def _values(cuts: list[list[int]]) -> Column:
    """array<struct<segment, fp>> of fp: each whole segment."""
    return F.array(*[F.struct(F.lit(k).alias("segment"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << y for y in x)))).alias("fp")) for k, x in enumerate(cuts)])


def _variants_of(cuts: list[list[int]]) -> Column:
    """The variants of one whole segment, whose number stands in `segment`."""
    out = F.lit(None)
    for k, x in enumerate(cuts):
        out = F.when(F.col("segment") == k, _variants([x])).otherwise(out)
    return out


def _level(rows: DataFrame, outer: list[str], names: list[str], spec: SimHashSpec) -> tuple[DataFrame, DataFrame | None]:
    """(outer..., names..., fp): all variants of rows(outer..., fp), those that can hold over split_at rows apart (None: there are none).

    A variant holds the rows of two segment values, so with more than split_at
    one of these has over half; the values are counted, which combines before
    the shuffle, and both variants of a value go with it.
    """
    bits = F.col(outer[-2]) if outer else None
    values = rows.select(*outer, F.explode(_by_tag(bits, spec.max_bits, _values)).alias("s")).select(*outer, "s.segment", "s.fp")
    heavy = cut(values.groupBy(*outer, "segment", "fp").count().filter(F.col("count") > spec.split_at // 2))
    variants = rows.select(*outer, "fp", F.explode(_by_tag(bits, spec.max_bits, _variants)).alias("x")).select(*outer, F.col("x.tag").alias(names[0]), F.col("x.key").alias(names[1]), "fp")
    n = heavy.count()
    if not n:
        return variants, None
    listed = heavy.select(*outer, F.explode(_by_tag(bits, spec.max_bits, _variants_of)).alias("x")).select(*outer, F.col("x.tag").alias(names[0]), F.col("x.key").alias(names[1])).distinct()
    if n <= spec.broadcast_rows:
        listed = F.broadcast(listed)
    on = [*outer, *names]
    return variants.join(listed, on, "left_anti"), cut(variants.join(listed, on, "left_semi").select(*on, "fp"))


def links(distinct_fps: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """Edges (u, v) that connect whatever fingerprints lie within max_bits, through others or directly.

    distinct_fps(fp) has each fingerprint once.
    """
    every, outer, keys = list(range(WIDTH)), ["tag", "key"], ["tag", "key", "tag2", "key2"]
    light, heavy = _level(distinct_fps.select("fp"), [], outer, spec)
    edges = _link(_grouped(light, outer), outer, None, spec.max_bits)
    if heavy is None:
        return edges
    # The bits outside the segment differ by at most max_bits, so they are cut as the whole was.
    rest = {b: [x for x in every if x not in segment] for segment in segments(every, spec.max_bits) for b in segment}
    light, heavy = _level(heavy, outer, keys[2:], spec)
    edges = edges.unionByName(_link(_grouped(light, keys), keys, rest, spec.max_bits))
    if heavy is None:
        return edges
    return edges.unionByName(_link(_grouped(_blocks(heavy, keys, spec.split_at), [*keys, "pair"]), [*keys, "pair"], rest, spec.max_bits))


def _blocks(rows: DataFrame, keys: list[str], split_at: int) -> DataFrame:
    """rows(keys..., fp) once for each pair of blocks of its group that it belongs to, so that any two rows meet in a pair of few rows."""
    sizes = rows.groupBy(*keys).count().filter("count > 1").select(*keys, F.ceil(F.col("count") / F.lit(split_at)).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks"))
    placed = rows.join(sizes, keys).withColumn("own", own).select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    return placed.select(*keys, (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("pair"), "fp")


def near_duplicates(docs: DataFrame, spec: SimHashSpec = SimHashSpec()) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for every row of docs(doc_id, text, ...).

    root names the group whatever its ids; component_id is the smallest doc_id reachable over links of at most
    max_bits differing bits.  Null and wordless texts have fingerprint 0 and
    link like any other; equal rows all stay; rows of a null doc_id take part
    and get their group's smallest known id (null if it has none).  An empty
    table gives no rows; other columns of docs are ignored.
    """
    prints = cut(fingerprints(docs, spec))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp"), spec))
    by_root = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # cut, so that the join below has plain exchanges on both sides and a hot group's rows can be split
    least = cut(by_root.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = by_root.join(least, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", "text_key", "fp", "root", "component_id")
