"""Making this package importable in Python workers."""

from __future__ import annotations

import io
import pathlib
import uuid
import zipfile

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from corpusloom.session import local_dir

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers, once an application, by way of the cluster's shared folder if it names one."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_dir(spark)
    uri = f"{folder.rstrip('/')}/modules-{uuid.uuid4().hex}/{top.name}-core.zip"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)
