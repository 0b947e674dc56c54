"""Whole ingests: files to chunks against a manifest, and node deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, incremental
from corpusloom.sources import files, tables

MANIFEST = "file_hash string, source string, chunk_count long, ingested_at timestamp"


def new_documents(spark: SparkSession, folders: list[str], manifest_root: str) -> DataFrame:
    """(source, file_hash, text) of text and HTML files whose bytes the manifest doesn't know."""
    known = tables.read_version(spark, manifest_root, MANIFEST)
    read = files.texts(spark, folders).unionByName(files.html_pages(spark, folders))
    return read.join(known.select("file_hash"), "file_hash", "left_anti").select(F.col("path").alias("source"), "file_hash", "text")


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 100) -> DataFrame:
    """Cleaned chunks that pass the quality gate and cut no formula or table, with features and stable ids."""
    cleaned = docs.withColumn("text", X.clean_markdown(F.col("text"))).filter(X.quality_reason(F.col("text")) == "ok")
    cut = chunking.safe_windows(cleaned, "text", size, overlap).filter(X.quality_reason(F.col("chunk")) == "ok")
    chunk = F.col("chunk")
    return cut.select(chunking.chunk_id(F.col("source"), F.col("idx"), chunk).alias("chunk_id"), "source", "file_hash", "idx", "chunk", X.has_formula(chunk).alias("has_formula"), X.has_table(chunk).alias("has_table"), X.numeric_density(chunk).alias("numeric_density"))


def ingest(spark: SparkSession, folders: list[str], chunk_root: str, manifest_root: str) -> dict[str, int]:
    """Chunk what is new and append it, then record it; what is held is read for its ids alone and never written again.

    A run that fails before the manifest is written is simply done again: the
    chunks that it left are known by their ids.
    """
    docs = new_documents(spark, folders, manifest_root)
    chunks = chunk_documents(docs)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    held = tables.read_appended(spark, chunk_root, ddl)
    fresh = incremental.new_rows(chunks, held.select("chunk_id"), "chunk_id", F.col("idx")).select(*held.columns)
    tables.write_version(fresh, chunk_root)
    known = tables.read_version(spark, manifest_root, MANIFEST)
    unlisted = tables.read_appended(spark, chunk_root, ddl).join(known.select("file_hash"), "file_hash", "left_anti")
    new = unlisted.groupBy("file_hash", "source").agg(F.count("*").alias("chunk_count")).withColumn("ingested_at", F.current_timestamp()).select(*known.columns)
    tables.write_version(known.unionByName(new), manifest_root)
    total = tables.read_version(spark, manifest_root, MANIFEST)
    return total.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).first().asDict()
