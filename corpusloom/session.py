"""SparkSession factory with the settings the engine's plans expect."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC; callers on a cluster pass their own partition counts."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"),
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def local_dir(spark: SparkSession) -> str:
    """A temporary folder, for sessions whose executors are in this process; on a cluster they would not see it."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="corpusloom-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder of spark.checkpoint.dir and drop its lineage; a temporary folder serves only where none is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or local_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or local_dir(spark)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """df in parts of about `most` rows, by a hash of the key; each is small enough to be sent to every task."""
    parts = max(1, -(-df.count() // most))
    return [df] if parts == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def held(rows: DataFrame, keys: DataFrame, key: str, anti: bool = False, most: int = 1_000_000) -> DataFrame:
    """Rows whose `key` is among keys (anti: is not), met where they lie: keys go to every task, in blocks if there are many, and rows of long texts are not shuffled."""
    keys = cut(keys.select(key).distinct())
    known = blocks(keys, key, most)
    found = None
    for own, few in zip([rows] if len(known) == 1 else [rows.filter(F.pmod(F.xxhash64(key), F.lit(len(known))) == i) for i in range(len(known))], known, strict=True):
        met = own.join(F.broadcast(few), key, "left_anti" if anti else "left_semi")
        found = met if found is None else found.unionByName(met)
    return found


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores: a file of one row group would be one task's work.

    Inputs of many row groups, as large tables are, stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
