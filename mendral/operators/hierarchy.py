"""Closures and graph operators over directed edges (child, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendral.plans.storage import materialize, materialize_counted, materialize_measured

#: Dimension tables up to this many bytes are sent to every executor.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` stored, with a broadcast hint if its rows hold at most ``most`` bytes; larger frames are joined by shuffle.

    Storing measures it in the same run, so nothing upstream runs a second time.
    """
    stored, held = materialize_measured(df, "dimension")
    return F.broadcast(stored) if held <= most else stored


def closure(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(node, ancestor): the transitive closure of (child, parent), cycles allowed.

    Paths double in length each round, so the rounds are the logarithm of the
    depth; duplicates fold as they appear, however many paths join two nodes.
    ``reflexive`` adds every node that an edge touches to its own ancestors.
    """
    e = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL").distinct()
    reach, n = materialize_counted(e, "closure")
    while n:
        onward = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        reach, now = materialize_counted(reach.unionByName(reach.join(onward, "ancestor").select("node", F.col("further").alias("ancestor"))).distinct(), "closure")
        if now == n:
            break
        n = now
    if reflexive:
        nodes = e.select("node").union(e.select("ancestor")).distinct()
        return reach.unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct()
    return reach


def strict_ancestors(edges: DataFrame, roots: list | None = None) -> DataFrame:
    """Ancestors other than the node itself; nothing above ``roots`` is looked at."""
    e = edges if not roots else edges.where(~F.col("child").isin(roots))
    return closure(e, reflexive=False).where(F.col("node") != F.col("ancestor"))


def descendants(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """(node, descendant)."""
    return closure(edges, reflexive).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"))


def with_self(reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """A closure in which every one of ``nodes`` (one column) is its own ancestor as well."""
    c = nodes.columns[0]
    return reach.unionByName(nodes.select(F.col(c).alias("node"), F.col(c).alias("ancestor"))).distinct()


def closure_of(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes that are reached from a seed set (one column), seeds included.

    Walks from the seeds, a level a round, so that edges elsewhere cost nothing. Each
    level is written once; rounds end with the first level that brings nothing new.
    """
    c = seed.columns[0]
    e = edges.select(F.col("child").alias("at"), F.col("parent").alias("to"))
    front, n = materialize_counted(seed.select(F.col(c).alias("node")).where("node IS NOT NULL").distinct(), "reached")
    seen = front
    while n:
        step = e.join(front, F.col("at") == F.col("node"), "left_semi").select(F.col("to").alias("node")).where("node IS NOT NULL").distinct()
        front, n = materialize_counted(step.join(seen, "node", "left_anti"), "reached")
        if n:
            seen = seen.unionByName(front)
    return seen.select(F.col("node").alias(c))


def disjoint_pairs(disjoint: DataFrame, reach: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes with ancestors that are declared disjoint, either way round."""
    both = disjoint.select("a", "b").union(disjoint.select(F.col("b"), F.col("a"))).distinct()
    up_a = reach.select(F.col("ancestor").alias("a"), F.col("node").alias("x"))
    up_b = reach.select(F.col("ancestor").alias("b"), F.col("node").alias("y"))
    return both.join(up_a, "a").join(up_b, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def expand_unions(members: DataFrame) -> DataFrame:
    """(union, member): members of unions, through unions of unions, down to what is no union."""
    e = members.select(F.col("union").alias("child"), F.col("member").alias("parent"))
    reach = closure(e, reflexive=False).select(F.col("node").alias("union"), F.col("ancestor").alias("member"))
    return reach.join(members.select(F.col("union").alias("member")).distinct(), "member", "left_anti").select("union", "member")


def depth(edges: DataFrame, roots: list) -> DataFrame:
    """(node, depth): fewest edges to a root; nodes that reach none are absent. As many rounds as levels, each written once."""
    spark: SparkSession = edges.sparkSession
    kind = edges.schema["child"].dataType.simpleString()
    front, n = materialize_counted(spark.createDataFrame([(r,) for r in roots], "node string").select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("depth")).distinct(), "depth")
    seen, level = front, 0
    while n:
        level += 1
        up = front.select(F.col("node").alias("parent"))
        front, n = materialize_counted(edges.join(up, "parent", "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(level)), "depth")
        if n:
            seen = seen.unionByName(front)
    return seen


def _reflexive(reach: DataFrame) -> DataFrame:
    """A closure in which every node with an ancestor is one of its own, so that facts are read once."""
    return small(with_self(reach, reach.select("node")))


def propagate_annotations(annotations: DataFrame, reach: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """True-path rule: every annotation holds for the ancestors of its term; unknown terms stay."""
    keys = keys or [c for c in annotations.columns if c != "term"]
    up = annotations.join(_reflexive(reach), F.col("term") == F.col("node"), "left")
    return up.select(*keys, F.coalesce("ancestor", "term").alias("term")).distinct()


def propagate_scores(predictions: DataFrame, reach: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each ancestor gets the greatest score of its descendants and itself."""
    keys = keys or [c for c in predictions.columns if c not in ("term", "score")]
    up = predictions.join(_reflexive(reach), F.col("term") == F.col("node"), "left").select(*keys, F.coalesce("ancestor", "term").alias("term"), "score")
    return up.groupBy(*keys, "term").agg(F.max("score").alias("score"))


def specific_terms(annotations: DataFrame, reach: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Terms of an entity that are no strict ancestor of another of its terms.

    The set is taken before any term is dropped, so the result does not depend on
    an order of terms.
    """
    keys = keys or [c for c in annotations.columns if c != "term"]
    strict = reach.where("node <> ancestor")
    above = annotations.join(small(strict), F.col("term") == F.col("node")).select(*keys, F.col("ancestor").alias("term")).distinct()
    return annotations.select(*keys, "term").distinct().join(above, [*keys, "term"], "left_anti")


def siblings(edges: DataFrame) -> DataFrame:
    """(parent, a, b), a < b: pairs of children of one parent."""
    e = edges.select("parent", "child").distinct()
    return e.withColumnRenamed("child", "a").join(e.withColumnRenamed("child", "b"), "parent").where("a < b").select("parent", "a", "b")


def implied_edges(edges: DataFrame, universe: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of which both ends are in the universe (keys, term) of a group."""
    lower = universe.select(*keys, F.col("term").alias("child"))
    upper = universe.select(*keys, F.col("term").alias("parent"))
    return lower.join(small(edges.select("child", "parent").distinct()), "child").join(upper, [*keys, "parent"], "left_semi").select(*keys, "child", "parent")


def roots_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def is_below(reach: DataFrame, node: Column, ancestor: Column) -> DataFrame:
    return reach.where((F.col("node") == node) & (F.col("ancestor") == ancestor))
