"""Tables of unique keys in buckets, where a merge rewrites the buckets that it changes and no others.

``data/version=v/bucket=b`` holds a bucket as version v wrote it, and ``manifest/v=n``
names the current version of every bucket.  The manifest is written last, so a
merge that fails leaves the table as it was, and readers see whole merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.session import cut
from corpusloom.sources import tables as T


class KeyedTable:
    """root: a folder that the driver and all executors share; schema: of the rows, a string; keys: columns that name a row."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifest(self) -> dict[int, int]:
        """Current version of each bucket that has rows; `buckets` numbers at most."""
        rows = T.read_version(self.spark, f"{self.root}/manifest", "bucket int, version int").collect()
        return {r.bucket: r.version for r in rows}

    def _read(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.root}/data"
        return self.spark.read.schema(self.schema).parquet(*[f"{data}/version={v}/bucket={b}" for b, v in sorted(places.items())])

    def rows(self) -> DataFrame:
        return self._read(self.manifest())

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in wanted(keys...); other buckets are not read."""
        held = {r.bucket for r in wanted.select(self._bucket()).distinct().collect()}
        return self._read({b: v for b, v in self.manifest().items() if b in held}).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def merge(self, new: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put rows of the table's columns in; returns the buckets that changed.

        combine takes the old and new rows of the touched buckets together and
        returns one row a key; merging the same rows again must change nothing.
        Rows with a null key are left out.  If a key would stand twice, nothing is
        written.
        """
        columns = self.spark.createDataFrame([], self.schema).columns
        new = cut(new.select(*columns).dropna(subset=self.keys))
        places = self.manifest()
        touched = {r.bucket for r in new.select(self._bucket()).distinct().collect()}
        old = self._read({b: v for b, v in places.items() if b in touched})
        merged = cut(combine(old.unionByName(new)).select(*columns, self._bucket()))
        twice = merged.groupBy(*self.keys).count().filter("count > 1").drop("count").take(3)
        if twice:
            raise ValueError(f"keys that stand more than once: {[tuple(r) for r in twice]}")
        fresh = merged.drop("bucket").exceptAll(old).unionByName(old.exceptAll(merged.drop("bucket")))
        changed = sorted(r.bucket for r in fresh.select(self._bucket()).distinct().collect())
        if not changed:
            return []
        number = (T.versions(self.spark, f"{self.root}/manifest") or [0])[-1] + 1
        own = merged.filter(F.col("bucket").isin(changed))
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={number}")
        full = {r.bucket for r in own.select("bucket").distinct().collect()}  # a bucket that lost all its rows has no folder
        now = {b: v for b, v in places.items() if b not in changed} | dict.fromkeys(full, number)
        if (written := T.write_version(self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1), f"{self.root}/manifest")) != number:
            raise RuntimeError(f"version {number} was written as {written}: one merge at a time")
        return changed

    def check(self) -> None:
        """Raise if any key stands twice in the table."""
        twice = self.rows().groupBy(*self.keys).count().filter("count > 1").take(3)
        if twice:
            raise ValueError(f"keys that stand more than once: {[tuple(r) for r in twice]}")
