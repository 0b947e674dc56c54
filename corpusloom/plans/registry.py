"""Registry of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread

#: Tables of long texts, where the work on a row is much more than moving it.
TEXTS = ("documents", "pages")


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the data set; columns, if given, are taken before texts are spread over the cores."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        found = found.select(*columns)
    return spread(found) if name in TEXTS and {"text", "html"} & set(found.columns) else found


class Catalogue(dict):
    """name -> Query; ``@catalogue.add(sql)`` registers a builder under its own name."""

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(build):
            key = name or build.__name__
            if key in self:
                raise ValueError(f"query {key} is registered twice")
            self[key] = Query(build, sql.strip() if sql else None)
            return build

        return keep
