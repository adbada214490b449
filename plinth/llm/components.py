"""Connected components by alternating stars, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, meet, stored


def _least(edges: DataFrame) -> DataFrame:
    """The least `b` of each `a`, and how many there are."""
    return stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))


def _stars(edges: DataFrame) -> DataFrame:
    """a > b in, a > b out: every node's larger neighbours go to its least one (large star), then every node and its smaller neighbours go to the least of those (small star). A hub's links stay where they are: its least neighbour comes to them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    large = stored(meet(both, least, ["a"]).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct())
    low = _least(large)
    small = meet(large, low, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    out = stored(small.filter("a <> b").distinct())
    forget(least, large, low)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node but the roots themselves; the root is the component's least node.

    `links` may repeat, be turned around, or join a node to itself; rows with a null end are no
    links; no links give no rows. Nodes and links stay distributed, and only counts come to the
    driver.
    """
    given = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = stored(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    said = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if said == (now["n"], now["h"]) or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        said = (now["n"], now["h"])
        before, edges = edges, _stars(edges)
        forget(before)
