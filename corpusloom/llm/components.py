"""Connected components of an edge table by alternating large and small stars.

Every round is two map-side combined minimum aggregations and two equi joins,
so a hub's edges are never gathered in one task: the aggregations combine
before the shuffle and adaptive execution splits a hot join key.  Rounds are
cut with checkpoints, and nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.workspace import cut


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of any ordered type -> (node, root), root the least node reachable.

    Nodes without an edge don't appear.  Self loops and repeated edges are
    allowed; rows with a null end are ignored; an empty input gives no rows.
    """
    stars = cut(
        edges.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = _fingerprint(stars)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        stars = cut(_small_star(_large_star(stars)))
        now = _fingerprint(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
