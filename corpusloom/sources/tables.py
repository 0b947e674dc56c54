"""Versioned tables: a write goes to a new folder, then a pointer names it; readers never see half a write."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions of a table, in order."""
    _, at, fs = _hadoop(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    jvm = spark.sparkContext._jvm
    done = [n for n in names if re.fullmatch(r"v=\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def write_version(rows: DataFrame, root: str) -> int:
    """Write rows as the next version; it counts once its _SUCCESS marker is there."""
    spark = rows.sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    rows.write.mode("overwrite").parquet(f"{root}/v={number}")
    return number


def read_version(spark: SparkSession, root: str, schema: str, number: int | None = None) -> DataFrame:
    """The latest version, or a given one; an empty table where there is none."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v={number or known[-1]}")


def read_appended(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All versions of a table together, where each holds what was added; an empty table where there is none."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/v={n}" for n in known])


def clear(spark: SparkSession, root: str) -> None:
    _, at, fs = _hadoop(spark, root)
    fs.delete(at, True)
