"""Connected components by alternating large-star and small-star, as joins and grouped minima.

No neighbour list is ever gathered: a star step takes the minimum of each node's neighbours by a
grouped aggregate (combined before the shuffle) and joins it back, so that a node with a third of
all edges costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each neighbour above a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its neighbours below it to the least of them; edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    Ends when a round changes nothing (the edges then are stars around the least nodes); raises if
    that takes more than ``rounds`` rounds, which are logarithmic in the length of the longest path.
    """
    now = runtime.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        then = runtime.stored(_small_star(_large_star(now)), "edges")
        runtime.drop_stored(now)
        now, was, seen = then, seen, mark(then)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
