"""Incremental maintenance: anti-joins against what is known, deltas, staged replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def new_rows(rows: DataFrame, known: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows whose key is not known yet, the first of each key; applying the result again adds nothing."""
    fresh = rows.join(known.select(key).distinct(), key, "left_anti")
    others = [c for c in rows.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("row")).select(key, "row.*")


def delta_verdicts(rows: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """rows with verdict new, updated or skip against state(key, old)."""
    joined = rows.join(state.select(key, F.col(digest).alias("_old")), key, "left")
    verdict = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(digest), "updated").otherwise("skip")
    return joined.withColumn("verdict", verdict).drop("_old")


def replace_rows(current: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """current without the keys of changed, and changed: the staged form of delete, then insert."""
    return current.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def order_free_checksum(rows: DataFrame, canonical: Column) -> DataFrame:
    """One row with a digest that no order of rows changes: counts and sums of the rows' digests, hashed.

    Sums combine in every task, so no list of all rows is ever made.
    """
    digest = F.sha2(canonical, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("checksum"))
