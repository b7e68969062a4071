"""Connected components by alternating large-star and small-star rewrites.

A large star attaches the greater neighbours of each node to the least of its
neighbourhood, a small star the lesser ones; edges fold as they coincide, and the
rewriting ends when an edge table comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendral.plans.storage import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _rewrite(edges: DataFrame, large: bool) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(back) if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(least, "a")
    out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return materialize(out.where("a > b").distinct(), "stars")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) of two different numbers touches; a component is named after its least node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    before, now = None, _mark(edges)
    while now != before:
        edges = _rewrite(_rewrite(edges, large=True), large=False)
        before, now = now, _mark(edges)
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
