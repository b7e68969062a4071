"""Connected components by alternating large-star and small-star rewrites.

Each rewrite attaches the neighbours of a node to the least of them. Minima
aggregate before the shuffle and the join against them has two plain inputs, so
the runtime can split a hub of any degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _attach(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (a > b). Large star looks at all neighbours, small star at smaller ones."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = materialize(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "stars")
    moved = near.join(least, F.col("a") == F.col("u"))
    if both:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select("b", "m").unionByName(least.select(F.col("u").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    result = materialize(out.where("a > b").distinct(), "edges")
    discard(least)
    return result


def components(links: DataFrame, most: int = 64) -> DataFrame:
    """(node, component) of every node that a link (a, b) touches; component is the least node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = _digest(edges)
    for _ in range(most):
        large = _attach(edges, both=True)
        small = _attach(large, both=False)
        discard(edges, large)
        edges, after = small, _digest(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
