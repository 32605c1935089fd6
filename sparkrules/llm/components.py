"""Connected components of a table of links, as Spark jobs.

Alternating star contraction: a large-star step links every larger neighbour of a node to the smallest node around
it, a small-star step does so with the smaller neighbours. Each step is a minimum per node, combined map-side, and one
join, so a node with very many links is never collected. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrules.storage import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links run from the larger node ``a`` to the smaller ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    stars = links.join(least, "a")
    moved = stars.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of the component.

    Nodes are of one ordered type; null ends are dropped and a link of a node to itself makes a component of one.
    """
    links = links.filter("a is not null and b is not null")
    ends = stored(links.select("a").union(links.select("b")).distinct())
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = stored(_small(_large(now)))
        # both steps leave a forest of stars alone; a hash sum over the links tells whether anything moved
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    return ends.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("root"))
