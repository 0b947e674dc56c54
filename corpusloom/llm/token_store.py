"""Token ids as Parquet list columns that can be read selectively.

Documents are range-sorted by id, encoded and written by the task that holds
them: one file a range, the ids as a list column under dictionary or delta
encoding, the metadata beside it, row groups closed at a token budget, and a
page index over all columns.  A reader takes the metadata without the ids, or
some documents without the rest: files are passed over by the manifest's id
ranges and row groups by their statistics.  Any Parquet reader that knows page
indexes can also skip pages.  The manifest (one row a file, a DataFrame) is
materialised when the files are complete; the files of a lost or repeated
attempt have other names and are never listed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.llm.vocab import WORD_BPE, encoder, vocabulary_path
from corpusloom.llm.workspace import arrow_map, cut, file_system, fresh_dir, slices


@dataclass(frozen=True)
class TokenStoreSpec:
    """end_id closes each document; encoding "dictionary" or "delta"; a row group closes at group_tokens, looked at after every batch_docs documents; max_entries: pieces that a task remembers."""

    vocabulary: str = WORD_BPE
    white_space: str = "dropped"
    end_id: int = 1
    encoding: str = "dictionary"
    group_tokens: int = 1 << 21
    page_bytes: int = 128 << 10
    batch_docs: int = 64
    max_entries: int = 600_000
    partitions: int | None = None


FILE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def open_writer(uri: str, schema: pa.Schema, lists: str, encoding: str, page_bytes: int) -> pq.ParquetWriter:
    """A writer with page indexes whose list column has the encoding asked for."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    others = [f.name for f in schema if f.name != lists]
    coded = {"use_dictionary": [*others, f"{lists}.list.element"]} if encoding == "dictionary" else {"use_dictionary": others, "column_encoding": {f"{lists}.list.element": "DELTA_BINARY_PACKED"}}
    return pq.ParquetWriter(path, schema, filesystem=fs, compression="zstd", compression_level=1, write_page_index=True, data_page_size=page_bytes, dictionary_pagesize_limit=1 << 20, **coded)


def list_array(parts: list[bytes]) -> pa.Array:
    """list<int32> of texts' ids given as little-endian bytes."""
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4))).astype(np.int32)
    values = np.frombuffer(b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def write_tokens(docs: DataFrame, out: str | None = None, spec: TokenStoreSpec = TokenStoreSpec()) -> DataFrame:
    """Encode docs(doc_id, text, lang, source, ...) in ascending doc_id order; returns the manifest.

    manifest: (part, path, n_docs, n_tokens, least_id, most_id), one row a file, part in id order.
    A file's `before` column counts the ids that stand before a document in it.
    Null and empty texts are one end id.  Rows of a null doc_id come first;
    equal ids stand next to each other, ordered by a hash of the text.  A missing lang or
    source is written as null; other columns are not stored.  No rows, no files.
    """
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "tokens")
    path = vocabulary_path(spec.vocabulary)
    end = int(spec.end_id).to_bytes(4, "little")
    parts = spec.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    )
    # the hash lets rows of one id (or none) spread over several ranges
    ordered = wanted.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known = encoder(path, spec.white_space, spec.max_entries)
        uri = f"{out}/part-{part:06d}-{uuid.uuid4().hex}.parquet"
        writer, held, held_tokens, n_docs, n_tokens, least, most = None, [], 0, 0, 0, None, None
        for batch in slices(batches, spec.batch_docs):
            if writer is None:
                writer = open_writer(uri, FILE_SCHEMA, "ids", spec.encoding, spec.page_bytes)
            ids = [x + end for x in known.encode([t or "" for t in batch.column(1).to_pylist()])]
            lengths = [len(x) // 4 for x in ids]
            before = n_tokens + np.cumsum([0, *lengths[:-1]])
            held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), list_array(ids)], schema=FILE_SCHEMA))
            known_ids = batch.column(0).drop_null()
            if len(known_ids):
                least, most = known_ids[0].as_py() if least is None else least, known_ids[-1].as_py()
            n_docs, n_tokens, held_tokens = n_docs + len(ids), n_tokens + sum(lengths), held_tokens + sum(lengths)
            if held_tokens >= spec.group_tokens:
                writer.write_table(pa.Table.from_batches(held), row_group_size=n_docs)
                held, held_tokens = [], 0
        known.forget()
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=n_docs)
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64()), "least_id": pa.array([least], pa.int64()), "most_id": pa.array([most], pa.int64())})

    return cut(arrow_map(ordered, run, "part int, path string, n_docs long, n_tokens long, least_id long, most_id long"))


def task_a_file(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest dealt out over as many tasks, whatever their size; none of them reaches the driver."""
    return manifest.repartition(max(1, manifest.count()), "path")


def read_tokens(
    spark: SparkSession, manifest: DataFrame, with_ids: bool = True, digests: bool = False, ids: list[int] | None = None, low: int | None = None, high: int | None = None
) -> DataFrame:
    """(doc_id, lang, source, start, n_tokens[, ids][, ids_crc32]) from the files of a manifest.

    start counts the ids of all documents before, over files in id order.
    Without ids and digests only the metadata columns are read.  ids (a list that
    every task gets) or low and high (both included) select documents: other
    files aren't opened, other row groups not read; a null doc_id is never selected.
    """
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", base.alias("base"), "least_id", "most_id")
    picked = np.unique(np.array(ids, np.int64)) if ids is not None else None
    selective = picked is not None or low is not None or high is not None
    if picked is not None:
        low = max(low if low is not None else -(1 << 63), int(picked[0]) if len(picked) else 1)
        high = min(high if high is not None else (1 << 63) - 1, int(picked[-1]) if len(picked) else 0)
    if low is not None:
        files = files.filter(F.col("most_id") >= low)
    if high is not None:
        files = files.filter(F.col("least_id") <= high)
    columns = ["doc_id", "lang", "source", "before", "n_tokens"] + ["ids"] * (with_ids or digests)
    schema = "doc_id long, lang string, source string, start long, n_tokens long" + ", ids array<int>" * with_ids + ", ids_crc32 long" * digests

    def wanted(doc_id: np.ndarray) -> np.ndarray:
        ok = np.isin(doc_id, picked) if picked is not None else np.ones(len(doc_id), bool)
        if low is not None:
            ok &= doc_id >= low
        return ok & (doc_id <= high) if high is not None else ok

    def groups(file: pq.ParquetFile) -> list[int]:
        """Row groups that can hold a selected document, by their statistics."""
        out = []
        for k in range(file.num_row_groups):
            found = file.metadata.row_group(k).column(0).statistics
            if found is None or not found.has_min_max:
                continue  # only null ids
            if (low is None or found.max >= low) and (high is None or found.min <= high) and (picked is None or np.searchsorted(picked, found.min) < np.searchsorted(picked, found.max, side="right")):
                out.append(k)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    file = pq.ParquetFile(source)
                    for part in file.iter_batches(512, columns=columns, row_groups=groups(file) if selective else None):
                        if selective:
                            known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                            part = part.filter(pa.array(known & wanted(part.column("doc_id").fill_null(0).to_numpy())))
                        starts = part.column("before").to_numpy() + base
                        arrays = [part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(starts, pa.int64()), part.column("n_tokens")]
                        names = ["doc_id", "lang", "source", "start", "n_tokens"]
                        if with_ids or digests:
                            ids = part.column("ids")
                            flat, ends = ids.flatten().to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
                            if (np.diff(ends) != part.column("n_tokens").to_numpy()).any():
                                raise ValueError(f"{path}: ids and lengths differ")
                        if with_ids:
                            arrays, names = [*arrays, ids], [*names, "ids"]
                        if digests:
                            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                            arrays, names = [*arrays, pa.array(crc, pa.int64())], [*names, "ids_crc32"]
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(task_a_file(files.select("path", "base")), run, schema)
