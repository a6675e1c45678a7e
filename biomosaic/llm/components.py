"""Connected components of a graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settle, shards

#: Links kept in a partition between rounds.
LINKS = 20_000


def _smallest(edges: DataFrame, upward: bool) -> DataFrame:
    """Links of each node u to v are replaced by links to its smallest neighbour.

    upward: the neighbours above u move (large star), else those below it and u
    itself (small star). Grouping takes partial minima and the join meets one row a
    node, so that Spark can cut the partition of a node with very many links.
    """
    if upward:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if upward:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        joined = both.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of all nodes with a link: the smallest id reachable.

    Links to null or to itself are ignored; an empty graph has no rows. Rounds go
    on until a round changes nothing; each is kept in the checkpoint folder.
    """
    stars = settle(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while before != (now := _print(stars)):
        before = now
        if not now[0]:
            break
        # Links do not multiply: few of them need few partitions, and so few files.
        parts = min(shards(edges.sparkSession), now[0] // LINKS + 1)
        stars = settle(_smallest(_smallest(stars, True), False).coalesce(parts))
    leaves = stars.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return leaves.unionAll(leaves.select(F.col("component_id").alias("id"), "component_id").distinct())
