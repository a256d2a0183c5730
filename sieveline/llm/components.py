"""Connected components of a graph whose edges are a DataFrame, by alternating stars.

A large star links each larger neighbour of a node to the smallest node around it; a small star does so for the smaller
ones. Both keep components as they are, and together they end with each node linked to its component's smallest, after
rounds that grow with the logarithm of a component's size. No group is gathered in a task: minima are aggregated
before the shuffle, and joins on a node with many edges are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and a digest of them that their order doesn't change."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges here go from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (u, v) that give each node u of an edge (but the smallest) its component's smallest node v.

    ``edges`` has two columns of one comparable type; loops and repeated edges do no harm, and null ends are left out.
    """
    a, b = edges.columns
    now = scratch.save(edges.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while state[0]:
        large = scratch.save(_large_star(now))
        new = scratch.save(_small_star(large))
        scratch.drop(now)
        scratch.drop(large)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    return now
