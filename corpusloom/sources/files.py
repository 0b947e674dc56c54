"""Files as tables: discovery, text and HTML scans, JSON lines, parsers that callers bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.html import page_texts
from corpusloom.operators.chunking import route_formats
from corpusloom.shipping import ship


def discover(spark: SparkSession, folders: list[str], switches: set[str], most_bytes: int | None = None) -> DataFrame:
    """(path, length, file_name, source_type, category, gated) of all files of enabled formats under the folders.

    Only names and sizes are listed; contents are read by the scan that needs them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path", "length", "modificationTime")
    routed = route_formats(listed, switches).filter("enabled")
    if most_bytes is not None:
        routed = routed.filter(F.col("length") <= most_bytes)
    return routed.select("path", "length", F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), "source_type", "category", "gated")


def with_content(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, content, file_hash): SHA-256 of the bytes is a file's identity."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return read.select("path", "content", F.sha2("content", 256).alias("file_hash"))


def texts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, text) of text and Markdown files that aren't blank; bytes that are no UTF-8 are left out."""
    read = with_content(spark, folders).filter(F.lower("path").rlike(r"\.(txt|md)$"))
    text = F.replace(F.col("content").cast("string"), F.lit("\ufffd"), F.lit(""))
    return read.select("path", "file_hash", text.alias("text")).filter(F.col("text").rlike(r"\S"))


def html_pages(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(path, file_hash, text) of HTML files, parsed, without junk elements."""
    read = with_content(spark, folders).filter(F.lower("path").rlike(r"\.x?html?$"))
    return page_texts(read.select("path", "file_hash", F.col("content").cast("string").alias("text")), "text", "text")


def parsed(files: DataFrame, parsers: list[Callable[[bytes], str | None]]) -> DataFrame:
    """files(path, content) with the text of the first parser that gives one and its number; null where none does.

    Parsers of PDF, office files and images are the caller's; a failing one is
    passed over, and what it raised is kept in `error`.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                text, used, error = None, None, None
                for k, parser in enumerate(parsers):
                    try:
                        text = parser(bytes(content))
                    except Exception as e:  # noqa: BLE001  the next parser may do
                        error = f"{type(e).__name__}: {e}"
                        continue
                    if text:
                        used = k
                        break
                rows.append((path, text or None, used, error))
            yield pd.DataFrame(rows, columns=["path", "text", "parser", "error"]).astype({"parser": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, text string, parser int, error string")


GOLDEN = (
    "id string, stratum string, user_input string, reference string, reference_contexts array<string>, expected_entities array<string>, expected_quantities array<struct<value:double,unit:string>>, expected_formula string, answerable boolean, setup array<string>"
)


def golden_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON-lines files; blank and comment lines (// or #) go, a line that is no JSON raises with its file, number and text.

    Golden files are small: each is read as one row, so that its lines have numbers.
    """
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\\r?\\n", -1).alias("lines"), F.col("_metadata.file_path").alias("file"))
    lines = whole.select("file", F.posexplode("lines").alias("at", "value"))
    kept = lines.filter(~F.col("value").rlike(r"^\s*($|//|#)"))
    bad = F.expr("try_parse_json(value)").isNull()
    where = F.concat(F.lit("not JSON in "), "file", F.lit(":"), (F.col("at") + 1).cast("string"), F.lit(": "), F.substring("value", 1, 80))
    checked = F.when(bad, F.raise_error(where)).otherwise(F.col("value"))
    return kept.select(F.from_json(checked.cast("string"), GOLDEN).alias("item")).select("item.*").withColumn("answerable", F.coalesce("answerable", F.lit(True)))


def node_columns(nodes: DataFrame, body: Column) -> DataFrame:
    """Columns of JSON:API nodes: uuid, title, the parsed text of the body and a hash that changes with either."""
    get = lambda path: F.coalesce(F.get_json_object(body, path), F.lit(""))
    out = nodes.select(get("$.id").alias("uuid"), get("$.attributes.title").alias("title"), get("$.attributes.body.value").alias("text"))
    out = page_texts(out, "text", "text")
    return out.withColumn("content_hash", F.sha2(F.to_json(F.struct("title", "text")), 256))
