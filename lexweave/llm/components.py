"""Connected components of a table of links, as joins and grouped minima: no driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release



def _large_star(e: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself. The least ones are written: a hub's links
    then meet them in a join that AQE can split, which it can't while the join reads an aggregate of its own shuffle."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component is the smallest node reachable.

    Alternating large and small stars until nothing changes, which every table of links reaches; each round is written to the
    shared folder. A node without a link to a
    smaller or larger one does not appear. An empty table gives an empty table."""
    e = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = materialise(e, "links"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        after = materialise(_small_star(_large_star(e)), "links")
        release(e)
        e, before = after, state
