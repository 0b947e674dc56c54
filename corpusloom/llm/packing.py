"""Best-fit packing of token sequences, in bulk-synchronous sweeps.

Documents are encoded, closed with an end id, cut where they exceed the
capacity and written once; packing moves only (piece, length) and (sequence,
gap).  Pieces are taken by falling class of length (the bounds are capacity/2,
/3, /6, /12, ...), and each class is one round:

1. Pieces and gaps are range-sorted together by falling size, so that equal
   sizes spread over several ranges.  A gap that holds several of the class
   stands there once for each, at an equal share of its size.
2. Every range sweeps its own rows for successors: a piece takes the smallest
   gap above it that is still free.  Among pieces that want one gap the rank in
   the sort decides, the next in rank takes the next larger gap.
3. What a range leaves over meets what the ranges above it left, again by rank:
   two counts of each range settle which ordinals of which ranges belong
   together, and an equality join on them gives the pieces their gaps.
4. Pieces that no gap holds open as many new sequences as their volume fills
   (all that they need where a class leaves no choice), largest first; the rest
   goes on to the next round.
5. Gaps shrink by what they took.

The rounds end when no piece is left.  Their number depends on the capacity, not
on the corpus; nothing but the counts of ranges and classes reaches the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.token_store import list_array, open_writer, task_a_file
from corpusloom.llm.vocab import BYTE_BPE, encoder, vocabulary_path
from corpusloom.llm.workspace import arrow_map, cut, file_system, fresh_dir, slices


@dataclass(frozen=True)
class PackSpec:
    """ranges: of a round's sort (None: of about rows_per_range pieces and gaps, as many as the session's shuffle partitions at most while they stay under 50 times that)."""

    capacity: int = 2048
    vocabulary: str = BYTE_BPE
    white_space: str = "joined"
    end_id: int = 0
    max_entries: int = 200_000
    ranges: int | None = None
    rows_per_range: int = 20_000


STORED = pa.schema([("pid", pa.int64()), ("ids", pa.list_(pa.int32()))])
PIECES = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long, path string"
#: Classes of length end at capacity / 2, / 3, ...; the last takes all that is shorter.
DIVISORS = (2, 3, 6, 12, 24, 48)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(k, capacity) for k in range(first, n, capacity)]]


def write_pieces(docs: DataFrame, out: str, spec: PackSpec) -> DataFrame:
    """Encode, cut and write all of docs; one row a piece as in PIECES.

    Ids go to one file a task; a last row of each task has the file's path and
    nothing else.  The rows themselves are a table that Spark commits, so the
    files of lost or repeated attempts are in no row.
    """
    path, end, capacity = vocabulary_path(spec.vocabulary), int(spec.end_id).to_bytes(4, "little"), spec.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = encoder(path, spec.white_space, spec.max_entries)
        part = TaskContext.get().partitionId()
        uri, pid = f"{out}/ids/part-{part:06d}-{uuid.uuid4().hex}.parquet", part << 40
        writer = None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["pid", "doc_id", "piece", "start", "length", "ids_crc32", "path"]
        for batch in slices(batches):
            rows, parts = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), known.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                for k, (a, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part_ids = ids[4 * a : 4 * (a + n)]
                    rows.append((pid, doc, k, a, n, zlib.crc32(part_ids), None))
                    parts.append(part_ids)
                    pid += 1
            if rows:
                if writer is None:
                    writer = open_writer(uri, STORED, "ids", "dictionary", 128 << 10)
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                writer.write_batch(pa.RecordBatch.from_arrays([made.column(0), list_array(parts)], schema=STORED))
                yield made
        known.forget()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([*[pa.array([None], k) for k in kinds[:-1]], pa.array([uri])], names=names)

    arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES).write.parquet(f"{out}/pieces")
    return docs.sparkSession.read.schema(PIECES).parquet(f"{out}/pieces")


def match_brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair each closing bracket with the last opening one before it that is still free.

    opens is True for an opening bracket.  Returns the places of (the opening
    and the closing brackets of all pairs, closing ones without a partner,
    opening ones without a partner), the last two in order.
    """
    height = np.cumsum(np.where(opens, 1, -1))
    low = np.minimum(np.minimum.accumulate(height), 0) if len(height) else height
    lone = ~opens & (low < np.concatenate(([0], low[:-1])))
    level = np.where(opens, height - low, height - low + 1)
    inner = np.flatnonzero(~lone)
    order = inner[np.argsort(level[inner], kind="stable")]  # of one level, opening and closing ones take turns
    closing = np.flatnonzero(~opens[order])
    paired = order[closing - 1]
    free = np.ones(len(opens), bool)
    free[paired] = False
    return paired, order[closing], np.flatnonzero(lone), np.flatnonzero(opens & free)


SWEPT = "part int, kind int, id long, length long, sequence long, ordinal long"


def sweep(items: DataFrame, gaps: DataFrame, low: int, high: int, ranges: int) -> DataFrame:
    """Range-sort items(pid, length) and gaps(sequence, gap), and pair them inside each range.

    One row an item (kind 1): its sequence, or its ordinal among those that its
    range couldn't place; and one row a gap's free share (kind 0): its ordinal in its range.
    """
    shares = F.greatest(F.lit(1), F.expr(f"cast(gap div {high} as int)"))
    slots = gaps.filter(F.col("gap") > low).select(F.expr("gap").alias("gap"), "sequence", shares.alias("n")).select(F.expr("gap div n").alias("size"), F.lit(0).alias("kind"), F.col("sequence").alias("id"), "n")
    rows = slots.unionByName(items.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.lit(1).alias("n")))
    ranged = rows.repartitionByRange(ranges, F.desc("size"), "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        size, kind, ident, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4))
        at = np.repeat(order := np.lexsort((ident, kind, -size)), n[order])
        slot, item, lone, free = match_brackets(kind[at] == 0)
        slot, item, lone, free = at[slot], at[item], at[lone], at[free]
        ids = np.concatenate((ident[item], ident[lone], ident[free]))
        sequence, ordinal = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        sequence[: len(item)] = ident[slot]
        ordinal[len(item) :] = np.concatenate((np.arange(len(lone)), np.arange(len(free))))
        known = np.arange(len(ids)) < len(item)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(ids), TaskContext.get().partitionId(), np.int32)),
                pa.array((np.arange(len(ids)) < len(item) + len(lone)).astype(np.int32)),
                pa.array(ids),
                pa.array(np.concatenate((size[item], size[lone], size[free]))),
                pa.array(sequence, mask=~known),
                pa.array(ordinal, mask=known),
            ],
            names=["part", "kind", "id", "length", "sequence", "ordinal"],
        )

    return cut(arrow_map(ranged, run, SWEPT))


def meetings(left: dict[int, tuple[int, int]]) -> tuple[list[tuple], int]:
    """Which ordinals of which ranges belong together, and how many pieces meet nothing.

    left has (pieces, free shares) of each range.  A range's pieces take the last
    shares that the ranges above it still have.  Returns rows (part, low, high,
    from_part, base): the pieces of ordinal low + k take the share base - k of
    from_part, or are the (base + k)-th without any where from_part is None.
    """
    stack: list[list[int]] = []
    out, lone = [], 0
    for part, (pieces, shares) in sorted(left.items()):
        at = 0
        while at < pieces and stack:
            n = min(pieces - at, stack[-1][1])
            stack[-1][1] -= n
            out.append((part, at, at + n, stack[-1][0], stack[-1][1] + n - 1))
            at += n
            if not stack[-1][1]:
                stack.pop()
        if at < pieces:
            out.append((part, at, pieces, None, lone))
            lone += pieces - at
        if shares:
            stack.append([part, shares])
    return out, lone


def settle(taken: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """taken(sequence, pid, length) at their offsets in gaps(sequence, gap), and the gaps that are left, in one table.

    Rows with a pid are placements (sequence, pid, offset), the others gaps (sequence, gap).
    """
    rows = taken.select("sequence", "pid", "length", F.lit(None).cast("long").alias("gap")).unionByName(gaps.select("sequence", F.lit(None).cast("long").alias("pid"), F.lit(0).cast("long").alias("length"), "gap"))
    own = Window.partitionBy("sequence")
    before = F.sum("length").over(own.orderBy(F.desc("length"), "pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    whole = F.max("gap").over(own)
    return cut(rows.select("sequence", "pid", (F.lit(capacity) - whole + before).alias("offset"), (whole - F.sum("length").over(own)).alias("gap")))


def place(pieces: DataFrame, spec: PackSpec, out: str | None = None) -> DataFrame:
    """(pid, sequence, offset) of every piece of pieces(pid, length): best fit in rounds.

    The pieces are first written by class, so that a round reads its own alone.
    """
    spark, capacity = pieces.sparkSession, spec.capacity
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges_for(rows: int) -> int:
        return spec.ranges or max(1, -(-rows // (50 * spec.rows_per_range)), min(parts, -(-rows // spec.rows_per_range)))

    bounds = [capacity, *[capacity // d for d in DIVISORS], 0]
    number = sum((F.col("length") <= b).cast("int") for b in bounds[1:-1]) if len(bounds) > 2 else F.lit(0)
    classes = f"{out or fresh_dir(spark, 'classes')}/classes"
    pieces.filter("pid is not null").select("pid", "length", number.alias("class")).write.partitionBy("class").parquet(classes)
    sized = spark.read.schema("pid long, length long, class int").parquet(classes)
    counts = {r["class"]: r["count"] for r in sized.groupBy("class").count().collect()}  # one row a class
    # More than half of the capacity: each opens a sequence, named by its piece.
    placed = [sized.filter("class = 0").select("pid", F.col("pid").alias("sequence"), F.lit(0).cast("long").alias("offset"))]
    gaps = sized.filter((F.col("class") == 0) & (F.col("length") < capacity)).select(F.col("pid").alias("sequence"), (F.lit(capacity) - F.col("length")).alias("gap"))
    opened, k, carried, n_carried, longest = 0, 0, None, 0, 0
    while k + 1 < len(bounds) - 1 or n_carried:
        k += 1
        tail = k >= len(bounds) - 1
        n_new = 0 if tail else counts.get(k, 0)
        if not n_new and not n_carried:
            continue
        low, high = (0, max(1, longest)) if tail else (bounds[k + 1], bounds[k])
        n_items = n_new + n_carried
        ranges = ranges_for(n_items + counts.get(0, 0) + opened)  # no more gaps than sequences
        items = sized.filter(F.col("class") == k).select("pid", "length") if n_new else carried
        if n_new and n_carried:
            items = items.unionByName(carried).coalesce(ranges)
        swept = sweep(items, gaps, low, high, ranges)
        left: dict[int, list[int]] = {}
        for r in swept.filter("ordinal is not null").groupBy("part", "kind").count().collect():  # two rows a range
            left.setdefault(r["part"], [0, 0])[1 - r["kind"]] = r["count"]
        pairs, lone = meetings({p: tuple(v) for p, v in left.items()})
        taken = swept.filter("sequence is not null").select("sequence", F.col("id").alias("pid"), "length")
        if pairs:
            kinds = [("part", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("from_part", pa.int32()), ("base", pa.int64())]
            spans = F.broadcast(spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, zip(*pairs, strict=True), strict=True)})))  # at most two rows a range
            waiting = swept.filter("kind = 1 and ordinal is not null").join(spans, "part").filter("ordinal >= low and ordinal < high").select("id", "length", "from_part", "base", (F.col("ordinal") - F.col("low")).alias("nth"))
            shares = swept.filter("kind = 0").select(F.col("part").alias("from_part"), F.col("ordinal").alias("share"), F.col("id").alias("of"))
            met = waiting.filter("from_part is not null").withColumn("share", F.col("base") - F.col("nth")).join(shares, ["from_part", "share"])
            taken = taken.unionByName(met.select(F.col("of").alias("sequence"), F.col("id").alias("pid"), "length"))
        news, n_carried = 0, 0
        if lone:
            alone = waiting.filter("from_part is null").select(F.col("id").alias("pid"), "length", (F.col("base") + F.col("nth")).alias("rank"))
            size = alone.agg(F.max("length").alias("most"), F.sum("length").alias("volume")).first()
            each, longest = capacity // size["most"], size["most"]
            news = -(-lone // each)
            if capacity // (low + 1) > each:  # later rounds can fill these sequences further
                news = min(news, size["volume"] // capacity)
                if tail:
                    news = max(1, news) if lone == n_items else 0
            first = opened
            starts = alone.filter(F.col("rank") < news * each)
            taken = taken.unionByName(starts.select((-1 - first - F.expr(f"rank div {each}")).alias("sequence"), "pid", "length"))
            n_carried = max(0, lone - news * each)
            carried, opened = alone.filter(F.col("rank") >= news * each).select("pid", "length"), opened + news
        usable = gaps.filter(F.col("gap") > low)
        if news:
            usable = usable.unionByName(spark.range(news).select((-1 - (opened - news) - F.col("id")).alias("sequence"), F.lit(capacity).cast("long").alias("gap")))
        done = settle(taken, usable, capacity)
        placed.append(done.filter("pid is not null").select("pid", "sequence", "offset"))
        gaps = gaps.filter(F.col("gap") <= low).unionByName(done.filter("pid is null and gap > 0").select("sequence", "gap")).coalesce(ranges)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def read_ids(files: DataFrame) -> DataFrame:
    """(pid, ids) of the stored pieces of files(path); a file is one task's, and no two files share a pid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    yield from pq.ParquetFile(source).iter_batches(1024)

    return arrow_map(task_a_file(files), run, "pid long, ids array<int>")


def pack_documents(docs: DataFrame, spec: PackSpec = PackSpec(), with_ids: bool = True, out: str | None = None) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Pieces of a sequence follow each other without a gap from offset 0.  A null
    or empty text is its end id alone; repeated rows and null ids are packed as
    rows of their own; other columns are ignored; no rows give no rows.
    Without ids only the small columns are read back.
    """
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "pieces")
    written = write_pieces(docs, out, spec)
    found = written.filter("pid is not null").drop("path").join(place(written, spec, out), "pid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset"]
    if not with_ids:
        return found.select(*columns)
    return found.join(read_ids(written.filter("path is not null").select("path")), "pid").select(*columns, "ids")
