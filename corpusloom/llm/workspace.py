"""Where operators keep what executors and driver must both see.

Work tables and files go to the shared folder the cluster names in
``spark.checkpoint.dir``.  Only where that is unset and the session runs on this
machine alone (tests) does it get a temporary folder of its own; on a cluster
without that setting work stops, as executors would not see the driver's folder.
"""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import local_dir, spread  # noqa: F401  (the operators take spread from here)


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; also makes it the session's checkpoint folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        named = named or local_dir(spark)
        context.setCheckpointDir(named)
    return (named or held.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder, for files written by executors."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs); usable on executors."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    uri = f"{fresh_dir(spark, 'modules')}/{top.name}-llm.zip"
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows each, so that long texts don't pile up as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
