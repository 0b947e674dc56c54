"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased,
held as its 128-bit MD5.  The index keeps

* a log of signed references (key, doc_id, delta): inserting a document adds its
  distinct keys, deleting it takes them back, so every state can be left again;
  the net counts are the exact table.  After ``compact_after`` parts the log is
  rewritten as its net counts,
* the exact (key, n_docs, max_doc) of the keys that at least ``min_docs``
  documents hold at present; a change counts its own keys anew and no others, and
* for every shard a cuckoo filter of those keys.  A key that rises over the limit
  is inserted, one that falls below is deleted; a full filter is built anew from
  the exact table.  There are as many shards as keep ``keys_per_shard``.

Documents are told apart by doc_id: rows of one id count once, rows without an
id not at all (they hold no key of their own, and lose the lines of repeated keys).

``apply`` drops the lines of such keys everywhere but in the largest doc_id that
holds them.  Lines meet the filters first; what passes is settled by the exact
table.  Up to ``broadcast_bytes`` the filters and exact rows go to every worker
and texts are rewritten where they are read.  Beyond it lines and filters are
dealt out by shard, the lines of a shard over several tasks, each of which gets
the shard's filter before its lines; what passes is joined with the exact
table, where adaptive execution splits a hot key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.cuckoo import CuckooFilter, split_keys
from corpusloom.llm.workspace import arrow_map, cut, fresh_dir, ship, slices

SPACE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class LineSpec:
    """min_chars: code points of a key at least; min_docs: documents that make a key repeated; keys_per_shard: of a filter; lines_per_task: of a shard that meet its filter in one task; broadcast_rows: changed keys that may be sent to every task."""

    min_chars: int = 20
    min_docs: int = 3
    keys_per_shard: int = 200_000
    lines_per_task: int = 2_000_000
    broadcast_bytes: int = 64 << 20
    broadcast_rows: int = 500_000
    compact_after: int = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """MD5 of the line's key, None for one that is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _keys(docs: DataFrame, spec: LineSpec) -> DataFrame:
    """(doc_id, key): the distinct long keys of each row, with no Python."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce("text", F.lit("")), upper, upper.lower())
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE.decode())))
    long = F.array_distinct(F.filter(lines, lambda x: F.length(x) >= spec.min_chars))
    return docs.select("doc_id", F.explode(long).alias("line")).select("doc_id", F.unhex(F.md5("line")).alias("key"))


def _shard(key, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _spare(name: str, taken: list[str]) -> str:
    """name, or what it becomes with underscores before it, that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


class LineIndex:
    """The log, the exact counts and the filters of one index, in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str | None = None, spec: LineSpec = LineSpec()):
        ship(spark)
        self.spark, self.spec, self.root = spark, spec, root or fresh_dir(spark, "line-index")
        self.parts: list[str] = []
        self.written = 0
        self.shards = 1
        self._counts: DataFrame | None = None
        self._filters: DataFrame | None = None

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/log-{self.written:06d}"
        rows.select("key", "doc_id", "delta").write.parquet(path)
        self.written += 1
        return path

    def _log(self) -> DataFrame:
        return self.spark.read.schema("key binary, doc_id long, delta long").parquet(*self.parts)

    def references(self, of: DataFrame | None = None) -> DataFrame:
        """Exact (key, doc_id, n): n rows of that doc_id hold the key at present; only the keys of of(key) if it is given."""
        if not self.parts:
            return self.spark.createDataFrame([], "key binary, doc_id long, n long")
        log = self._log()
        if of is not None:
            log = log.join(of, "key", "left_semi")
        if len(self.parts) == 1:  # one insert's rows, each key and id once
            return log.select("key", "doc_id", F.col("delta").alias("n"))
        return log.groupBy("key", "doc_id").agg(F.sum("delta").alias("n")).filter("n > 0")

    def _counted(self, references: DataFrame) -> DataFrame:
        counts = references.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        return counts.filter(F.col("n_docs") >= self.spec.min_docs)

    def repeated(self) -> DataFrame:
        """Exact (key, n_docs, max_doc) of the keys that at least min_docs documents hold."""
        if self._counts is None:
            self._counts = cut(self._counted(self.references()))
        return self._counts

    def filters(self) -> DataFrame:
        """(shard, data): the cuckoo filter of each shard that has a repeated key."""
        if self._filters is None:
            self.shards = max(1, math.ceil(self.repeated().count() / self.spec.keys_per_shard))
            self._filters = cut(self._built(self.repeated()))
        return self._filters

    def _built(self, keys: DataFrame) -> DataFrame:
        def build(table: pa.Table) -> pa.Table:
            hi, lo = split_keys(_bytes_of(table.column("key").combine_chunks()))
            made = CuckooFilter.build(hi, lo)
            return pa.table({"shard": table.column("shard")[:1], "data": pa.array([made.dumps()], pa.binary())})

        # a shard has keys_per_shard keys or few more, so its group is bounded
        sharded = keys.select(_shard(F.col("key"), self.shards).alias("shard"), "key")
        return sharded.groupBy("shard").applyInArrow(build, "shard int, data binary")

    def _changed(self, docs: DataFrame, delta: int) -> None:
        """Append to the log, count the changed keys anew, and carry those that crossed the limit into the filters."""
        first = not self.parts
        rows = _keys(docs.filter("doc_id is not null"), self.spec).groupBy("key", "doc_id").agg((F.count("*") * delta).alias("delta"))
        if delta < 0:  # only what is held can be taken back, so that no count falls below zero
            rows = cut(rows)
            held = self.references(rows.select("key").distinct())
            rows = rows.join(held, ["key", "doc_id"]).select("key", "doc_id", F.greatest("delta", -F.col("n")).alias("delta"))
        self.parts.append(self._write(rows))
        if first or self._counts is None:
            self._counts = self._filters = None
            return
        changed = cut(self.spark.read.parquet(self.parts[-1]).select("key").distinct())
        if changed.count() <= self.spec.broadcast_rows:
            changed = F.broadcast(changed)
        old = self._counts.join(changed, "key", "left_semi")
        new = cut(self._counted(self.references(changed)))
        self._counts = cut(self._counts.join(changed, "key", "left_anti").unionByName(new))
        if self._filters is not None:
            rose = new.join(old.select("key"), "key", "left_anti").select("key", F.lit(1).alias("change"))
            fell = old.join(new.select("key"), "key", "left_anti").select("key", F.lit(-1).alias("change"))
            self._carry(cut(rose.unionByName(fell)))
        if len(self.parts) > self.spec.compact_after:
            self.compact()

    def _carry(self, changes: DataFrame) -> None:
        """Put risen keys into the filters, take fallen ones out, and build full filters anew."""
        if self._counts.count() > 2 * self.shards * self.spec.keys_per_shard:
            self._filters = None  # more shards are due
            return

        def update(shard: pa.Table, change: pa.Table) -> pa.Table:
            number = (shard if shard.num_rows else change).column("shard")[:1]
            held = CuckooFilter.loads(shard.column("data")[0].as_py()) if shard.num_rows else CuckooFilter.sized_for(change.num_rows)
            full = False
            if change.num_rows:
                hi, lo = split_keys(_bytes_of(change.column("key").combine_chunks()))
                up = np.array(change.column("change").to_pylist()) > 0
                for a, b in zip(hi[~up].tolist(), lo[~up].tolist(), strict=True):
                    full |= not held.delete(a, b)
                full = full or not held.insert_many(hi[up], lo[up])
            return pa.table({"shard": number, "data": pa.array([None if full else held.dumps()], pa.binary())})

        keyed = changes.withColumn("shard", _shard(F.col("key"), self.shards))
        updated = cut(self._filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(update, "shard int, data binary"))
        everything = self._counts.withColumn("shard", _shard(F.col("key"), self.shards)).select("shard", "key")
        rebuilt = self._built(everything.join(updated.filter("data is null").select("shard"), "shard", "left_semi").select("key"))
        self._filters = cut(updated.filter("data is not null").unionByName(rebuilt))

    def compact(self) -> "LineIndex":
        """Rewrite the log as its net counts."""
        self.parts = [self._write(self.references().withColumnRenamed("n", "delta"))]
        return self

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Count the rows of docs(doc_id, text, ...)."""
        self._changed(docs, 1)
        return self

    def delete(self, docs: DataFrame) -> "LineIndex":
        """Take back rows that were inserted with these ids and texts; what is not held changes nothing, as before any insert."""
        self._changed(docs, -1)
        return self

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with text rewritten, and n_lines (before), n_dropped.

        Null and empty texts are one empty line, and come back as empty text.
        Other columns pass through; columns of docs named n_lines or n_dropped
        are replaced.  All rows of the largest doc_id keep a key's lines; repeated
        rows are judged alike; rows without an id lose the lines of all repeated
        keys.  No rows give no rows.
        """
        docs = docs.drop("n_lines", "n_dropped")
        size = self.filters().agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        rows = self.repeated().count()
        if size + 24 * rows <= self.spec.broadcast_bytes:
            return self._apply_here(docs)
        return self._apply_joined(docs)

    def _apply_here(self, docs: DataFrame) -> DataFrame:
        spec, shards_in_all = self.spec, self.shards
        exact = self.repeated().select("key", "max_doc").toArrow()
        hi, lo = split_keys(_bytes_of(exact.column("key").combine_chunks()))
        order = np.lexsort((lo, hi))
        largest = exact.column("max_doc").combine_chunks().to_numpy(zero_copy_only=False)[order]
        table = self.spark.sparkContext.broadcast((hi[order], lo[order], largest))
        held = {r["shard"]: bytes(r["data"]) for r in self.filters().collect()}  # of a size checked by the caller
        filters = self.spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hi, lo, largest = table.value
            shards = {k: CuckooFilter.loads(v) for k, v in filters.value.items()}
            names = hi * np.uint64(0x9E3779B97F4A7C15) + lo if len(hi) else hi
            order = np.argsort(names)
            for batch in slices(batches, 512):
                ids = batch.column(0).to_pylist()
                split = [(t or b"").split(b"\n") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                owner, place, keys = [], [], []
                for i, lines in enumerate(split):
                    for j, line in enumerate(lines):
                        key = line_key(line, spec.min_chars)
                        if key is not None:
                            owner.append(i), place.append(j), keys.append(key)
                gone: dict[int, set[int]] = {}
                for n in _passed(keys, shards, shards_in_all):
                    a, b = split_keys(np.frombuffer(keys[n], np.uint8).reshape(1, 16))
                    with np.errstate(over="ignore"):
                        name = a[0] * np.uint64(0x9E3779B97F4A7C15) + b[0]
                    at = np.searchsorted(names, name, sorter=order)
                    while at < len(names) and names[order[at]] == name:
                        k = order[at]
                        if hi[k] == a[0] and lo[k] == b[0]:
                            if ids[owner[n]] != largest[k]:
                                gone.setdefault(owner[n], set()).add(place[n])
                            break
                        at += 1
                yield _rewritten(batch, split, gone)

        return _with_columns(docs, run)

    def _apply_joined(self, docs: DataFrame) -> DataFrame:
        spec = self.spec
        dropped = _spare("gone_keys", docs.columns)
        gone = (
            self._possible(_keys(docs, spec))
            .join(self.repeated(), "key")
            .filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
            .groupBy("doc_id")
            .agg(F.collect_set("key").alias(dropped))
            .withColumnRenamed("doc_id", "gone_id")
        )
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left").select(docs["doc_id"], docs["text"], gone[dropped], *[docs[c] for c in others])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 512):
                split = [(t or b"").split(b"\n") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                gone = {}
                for i, keys in enumerate(batch.column(2).to_pylist()):
                    if keys:
                        keys = set(keys)
                        gone[i] = {j for j, line in enumerate(split[i]) if line_key(line, spec.min_chars) in keys}
                yield _rewritten(batch.drop_columns([dropped]), split, gone)

        return _with_columns(joined, run, drop=dropped).select(*docs.columns, "n_lines", "n_dropped")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The rows of pairs(doc_id, key) that the filters may hold; no filter is sent to more tasks than its shard's lines need."""
        filters, n_shards = self.filters(), self.shards
        tasks = max(1, math.ceil(pairs.count() / n_shards / self.spec.lines_per_task))
        salt = F.pmod(F.xxhash64("doc_id", "key", F.lit("salt")), F.lit(tasks)).cast("int")
        lines = pairs.select(_shard(F.col("key"), n_shards).alias("shard"), salt.alias("salt"), F.lit(1).alias("kind"), "doc_id", "key")
        copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.col("data").alias("key"))
        dealt = lines.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, None
            for batch in batches:
                shards, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                edges = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (kinds[1:] == 0) | (kinds[:-1] == 0)))) if len(kinds) else np.zeros(0, int)
                for a, b in zip(edges, np.append(edges[1:], len(kinds)), strict=True):
                    if kinds[a] == 0:
                        shard, held = shards[a], CuckooFilter.loads(batch.column(4)[int(a)].as_py())
                    elif shard == shards[a]:
                        part = batch.slice(int(a), int(b - a))
                        hi, lo = split_keys(_bytes_of(part.column(4)))
                        yield pa.RecordBatch.from_arrays([part.column(3), part.column(4)], names=["doc_id", "key"]).filter(pa.array(held.contains(hi, lo)))

        return arrow_map(dealt, probe, "doc_id long, key binary")


def _bytes_of(keys: pa.Array) -> np.ndarray:
    joined = b"".join(keys.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, 16)


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)).view(np.int64) % shards


def _passed(keys: list[bytes], shards: dict[int, CuckooFilter], n_shards: int) -> list[int]:
    """Places of the keys that their shard's filter may hold."""
    if not keys:
        return []
    hi, lo = split_keys(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16))
    shard = _shard_of(keys, n_shards)
    ok = np.zeros(len(keys), bool)
    for s in np.unique(shard):
        if int(s) in shards:
            own = np.flatnonzero(shard == s)
            ok[own] = shards[int(s)].contains(hi[own], lo[own])
    return np.flatnonzero(ok).tolist()


def _rewritten(batch: pa.RecordBatch, split: list[list[bytes]], gone: dict[int, set[int]]) -> pa.RecordBatch:
    texts = [b"\n".join(x if i not in gone else [y for j, y in enumerate(x) if j not in gone[i]]) for i, x in enumerate(split)]
    text = pa.array(texts, pa.binary()).cast(batch.schema.field(1).type)
    arrays = [batch.column(0), text, *batch.columns[2:]]
    arrays += [pa.array([len(x) for x in split], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(split))], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "n_lines", "n_dropped"])


def _with_columns(docs: DataFrame, run, drop: str | None = None) -> DataFrame:
    from pyspark.sql import types as T

    first = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    fields = [T.StructField(f.name, f.dataType, True) for f in first.schema if f.name != drop]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return arrow_map(first, run, schema).select(*[c for c in docs.columns if c != drop], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """Insert all of docs into an index of their own and drop their repeated lines."""
    return LineIndex(docs.sparkSession, spec=spec).insert(docs).apply(docs)
