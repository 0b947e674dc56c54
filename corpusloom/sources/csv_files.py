"""CSV files as documents, one a row; what is wrong is kept beside what is right."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.shipping import ship

_SCHEMA = "path string, row long, text string, error string"


def csv_documents(spark: SparkSession, folder: str, most_bytes: int = 10_000_000, delimiter: str = ",") -> DataFrame:
    """(path, row, text, error) of the rows of all *.csv files under a folder; row counts from 1 after the header.

    text has a line `column: value` for each cell that is not blank.  A row of more
    or fewer cells than the header is kept with an error; cells beyond the header
    are named by their place.  A file that is over most_bytes, or is not UTF-8, or
    breaks off inside a quote, or is empty, is one row 0 with an error, after the
    rows that could be read.  Sizes are known from the listing, so a file that is
    too large is never opened; a file within the limit is one task's, and is held
    whole.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").load(folder)
    large = files.select("path", "length").filter(F.col("length") > most_bytes)
    large = large.select("path", F.lit(0).cast("long").alias("row"), F.lit(None).cast("string").alias("text"), F.format_string("%d bytes, over %d", "length", F.lit(most_bytes)).alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(parse(content, delimiter))
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    cols = [pa.array([path] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "row", "text", "error"])

    small = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInArrow(run, _SCHEMA)
    # the listing knows empty files too, which scans leave out
    listed = spark.createDataFrame([(unquote(p).replace("file:///", "file:/", 1),) for p in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("row"), F.lit(None).cast("string").alias("text"), F.lit("empty").alias("error"))
    return small.unionByName(large).unionByName(empty)


def parse(content: bytes, delimiter: str = ",") -> Iterator[tuple[int, str | None, str | None]]:
    """(row, text, error) of a file's rows, then of what is wrong with the file."""
    try:
        whole = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        yield 0, None, f"not UTF-8 at byte {e.start}"
        return
    csv.field_size_limit(max(csv.field_size_limit(), len(content) + 1))
    reader = csv.reader(io.StringIO(whole, newline=""), delimiter=delimiter, strict=True)
    header: list[str] | None = None
    k = 0
    try:
        for cells in reader:
            if not any(c.strip() for c in cells):
                continue
            if header is None:
                header = [c.strip() or f"column {i}" for i, c in enumerate(cells, 1)]
                continue
            k += 1
            names = header + [f"column {i}" for i in range(len(header) + 1, len(cells) + 1)]
            text = "\n".join(f"{n}: {c.strip()}" for n, c in zip(names, cells, strict=False) if c.strip())
            yield k, text, None if len(cells) == len(header) else f"{len(cells)} cells, not {len(header)}"
    except csv.Error as e:
        yield 0, None, f"line {reader.line_num}: {e}"
    if header is None:
        yield 0, None, "empty"
