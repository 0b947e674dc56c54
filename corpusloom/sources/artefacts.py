"""Computed tables named by what they were computed from: loaded where they are there, computed once where they are not."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.sources import tables as T


def seeds(spark: SparkSession, path: str | None, default: list[str]) -> list[str]:
    """The lines of a text file that are neither blank nor begin with #; the default where there is no file or no line. A list kept by hand."""
    if path:
        _, at, fs = T._hadoop(spark, path)
        if fs.exists(at):
            lines = [r.value.strip() for r in spark.read.text(path).collect()]
            if kept := [x for x in lines if x and not x.startswith("#")]:
                return kept
    return default


def table_print(rows: DataFrame) -> str:
    """A short text that changes when a table's rows do, whatever their order."""
    h = F.xxhash64(*rows.columns)
    n, low, high = rows.agg(F.count("*"), F.sum(F.shiftright(h, 32).cast("decimal(20,0)")), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)"))).first()
    return f"{n}-{low}-{high}"


def artefact(spark: SparkSession, root: str, name: str, inputs: list, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` for these inputs (texts, numbers, lists of them): read if it was finished before, else computed and written."""
    digest = hashlib.sha256(json.dumps(inputs, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{root.rstrip('/')}/{name}-{digest}"
    if not T.versions(spark, folder):
        T.write_version(compute(), folder)
    return spark.read.parquet(f"{folder}/v={T.versions(spark, folder)[-1]}")
