"""Taxon consistency: naive violations, satisfiability, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import above, demote
from .coherence import met_items
from .hierarchy import closure, disjoint_pairs, small


def lineages(genomes: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome, taxon): a genome's taxon and all above it."""
    up = genomes.join(small(reach), F.col("taxon") == F.col("node"), "left")
    return up.select("genome", F.coalesce("ancestor", "taxon").alias("taxon")).unionByName(genomes.select("genome", "taxon")).distinct()


def violating_terms(universe: DataFrame, constraints: DataFrame, genomes: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome, term, kind) of a universe (genome, term) that a genome's lineage rules out.

    A term is ruled out by a ``never_in_taxon`` in the lineage, or when none of its
    ``only_in_taxon`` is: one suffices here, unlike in the solver.
    """
    line = lineages(genomes, reach).withColumn("__in", F.lit(True))
    rows = universe.select("genome", "term").distinct().join(small(constraints.select("term", "kind", "taxon").distinct()), "term").join(line, ["genome", "taxon"], "left")
    met = rows.groupBy("genome", "term", "kind").agg(F.bool_or(F.coalesce("__in", F.lit(False))).alias("met"))
    return met.where("kind = 'never_in_taxon' AND met OR kind = 'only_in_taxon' AND NOT met").select("genome", "term", "kind")


def naive_flips(predictions: DataFrame, tau: float, constraints: DataFrame, genomes: DataFrame, reach: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(genome, term) to demote; with ``edges`` the terms below a violating one go too."""
    present = above(predictions, tau).select("genome", "term").distinct()
    if edges is None:
        return violating_terms(present, constraints, genomes, reach).select("genome", "term").distinct()
    # a term goes if any term above it, present or not, is ruled out
    up = present.join(small(closure(edges)), F.col("term") == F.col("node"), "left").select("genome", F.col("term").alias("below"), F.coalesce("ancestor", "term").alias("term"))
    bad = violating_terms(up, constraints, genomes, reach).select("genome", "term").distinct()
    return up.join(bad, ["genome", "term"], "left_semi").select("genome", F.col("below").alias("term")).distinct()


def naive_filter(predictions: DataFrame, tau: float, constraints: DataFrame, genomes: DataFrame, reach: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    return demote(predictions, naive_flips(predictions, tau, constraints, genomes, reach, edges), tau)


def violation_listing(annotations: DataFrame, constraints: DataFrame, genomes: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome, protein, term, kind, taxon): one row per kind; of several taxa the least is named."""
    bad = violating_terms(annotations, constraints, genomes, reach)
    named = bad.join(small(constraints.select("term", "kind", "taxon").distinct()), ["term", "kind"]).join(lineages(genomes, reach).withColumn("__in", F.lit(True)), ["genome", "taxon"], "left")
    # an only-in violation names any of its taxa, a never-in violation one of the lineage
    least = named.where("kind = 'only_in_taxon' OR __in").groupBy("genome", "term", "kind").agg(F.min("taxon").alias("taxon"))
    return annotations.select("genome", "protein", "term").distinct().join(least, ["genome", "term"]).select("genome", "protein", "term", "kind", "taxon")


def satisfiability(annotations: DataFrame, constraints: DataFrame, disjoint: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome, check, a, b): every reason why a genome's annotations can't hold together.

    1 one taxon required and excluded, 2 two required taxa disjoint through
    ancestors, 3 a required taxon below an excluded one, 4 a required taxon
    declared disjoint with everything else than an excluded one (``X_neg``).
    """
    required = annotations.select("genome", "term").distinct().join(small(constraints), "term").select("genome", "kind", "taxon").distinct()
    only = required.where("kind = 'only_in_taxon'").select("genome", F.col("taxon").alias("a"))
    never = required.where("kind = 'never_in_taxon'").select("genome", F.col("taxon").alias("b"))
    both = only.join(never, (only.genome == never.genome) & (F.col("a") == F.col("b"))).select(only.genome, F.lit(1).alias("check"), "a", "b")
    other = only.select("genome", F.col("a").alias("b"))
    apart = only.join(disjoint_pairs(disjoint, reach), "a").join(other, ["genome", "b"], "left_semi").select("genome", F.lit(2).alias("check"), "a", "b")
    strict = reach.where("node <> ancestor")
    below = only.join(strict.select(F.col("node").alias("a"), F.col("ancestor").alias("b")), "a").join(never, ["genome", "b"], "left_semi").select("genome", F.lit(3).alias("check"), "a", "b")
    negs = disjoint.select("a", "b").union(disjoint.select(F.col("b"), F.col("a"))).where(F.col("b").endswith("_neg")).select("a", F.regexp_replace("b", "_neg$", "").alias("b")).distinct()
    neg = only.join(negs, "a").join(never, ["genome", "b"], "left_semi").select("genome", F.lit(4).alias("check"), "a", "b")
    return both.unionByName(apart).unionByName(below).unionByName(neg)


def conflicts(constraints: DataFrame, disjoint: DataFrame, reach: DataFrame) -> DataFrame:
    """(a, b): pairs of constraints (kind, taxon) that no genome can meet both; the checks of ``satisfiability`` on taxa alone."""
    taxa = constraints.select("kind", "taxon").where("taxon IS NOT NULL").distinct()
    only, never = (taxa.where(F.col("kind") == kind).select(F.col("taxon").alias(c)) for kind, c in (("only_in_taxon", "a"), ("never_in_taxon", "b")))
    negs = disjoint.select("a", "b").union(disjoint.select(F.col("b"), F.col("a"))).where(F.col("b").endswith("_neg")).select("a", F.regexp_replace("b", "_neg$", "").alias("b"))
    strict = reach.where("node <> ancestor").select(F.col("node").alias("a"), F.col("ancestor").alias("b"))
    same = only.select("a", F.col("a").alias("b"))
    excluded = same.unionByName(strict).unionByName(negs).join(only, "a", "left_semi").join(never, "b", "left_semi")
    apart = disjoint_pairs(disjoint, reach).join(only, "a", "left_semi").join(only.select(F.col("a").alias("b")), "b", "left_semi")
    pair = lambda rows, kind: rows.select(F.struct(F.lit("only_in_taxon").alias("kind"), F.col("a").alias("taxon")).alias("a"), F.struct(F.lit(kind).alias("kind"), F.col("b").alias("taxon")).alias("b"))
    return pair(excluded, "never_in_taxon").unionByName(pair(apart, "only_in_taxon")).distinct()


def unsatisfiable(annotations: DataFrame, constraints: DataFrame, disjoint: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome) whose annotations can't hold together. Rows that come dealt by genome are not moved."""
    listed = constraints.select("term", F.struct("kind", "taxon").alias("constraint")).distinct()
    required = annotations.select("genome", "term").join(small(listed), "term").select("genome", F.col("constraint").alias("term")).distinct()
    return met_items(required, conflicts(constraints, disjoint, reach), "a", "b").where("asked AND met").select("genome").distinct()


def satisfiable(annotations: DataFrame, constraints: DataFrame, disjoint: DataFrame, reach: DataFrame) -> DataFrame:
    """(genome, satisfiable) for every genome with annotations."""
    bad = unsatisfiable(annotations, constraints, disjoint, reach).withColumn("__bad", F.lit(True))
    return annotations.select("genome").distinct().join(bad, "genome", "left").select("genome", F.col("__bad").isNull().alias("satisfiable"))


def explanations(reasons: DataFrame, annotations: DataFrame, constraints: DataFrame, most: int = 50) -> DataFrame:
    """(genome, explanation): up to ``most`` proteins that carry terms of the taxa at odds."""
    taxa = reasons.select("genome", F.explode(F.array("a", "b")).alias("taxon")).distinct()
    proteins = annotations.join(small(constraints), "term").join(taxa, ["genome", "taxon"], "left_semi").select("genome", "protein").distinct()
    ranked = proteins.withColumn("r", F.row_number().over(Window.partitionBy("genome").orderBy("protein")))
    total = ranked.groupBy("genome").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("protein")))).alias("p"))
    return total.select("genome", F.concat(F.array_join("p", ", "), F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")).alias("explanation"))
