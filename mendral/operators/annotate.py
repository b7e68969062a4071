"""Predicates, projections and counts over predictions (genome, protein, term, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import small

COST_SCALE = 1_000_000
#: Promotions are lifted this far above the threshold.
LIFT = 0.001


def above(predictions: DataFrame, tau: float | Column) -> DataFrame:
    """Annotated rows: strictly above the threshold."""
    return predictions.where(F.col("score") > tau)


def at_least(predictions: DataFrame, floor: float) -> DataFrame:
    """Rows at or above a sparsity floor."""
    return predictions.where(F.col("score") >= floor)


def in_namespace(predictions: DataFrame, terms: DataFrame, namespace: str, root: str | None = None) -> DataFrame:
    wanted = terms.where(F.col("namespace") == namespace).select(F.col("id").alias("term"))
    kept = predictions.join(small(wanted), "term", "left_semi")
    return kept if root is None else kept.where(F.col("term") != root)


def with_thresholds(predictions: DataFrame, thresholds: DataFrame, default: float, key: str = "fold") -> DataFrame:
    """``tau`` of each row's fold, or the default."""
    return predictions.join(small(thresholds.select(key, F.col("tau").alias("__tau"))), key, "left").withColumn("tau", F.coalesce("__tau", F.lit(default))).drop("__tau")


def flip_costs(predictions: DataFrame, tau: float, mode: str = "margin", ic: DataFrame | None = None) -> DataFrame:
    """(genome, term, cost, scaled, n): what demoting a term from a whole genome costs."""
    rows = above(predictions, tau)
    if mode == "margin":
        cost = F.sum(F.col("score") - tau)
    elif mode == "uniform":
        cost = F.count("*").cast("double")
    elif mode == "ic":
        if ic is None:
            raise ValueError("mode 'ic' needs a table (term, ic)")
        rows = rows.join(small(ic.select("term", "ic")), "term", "left")
        cost = F.sum(F.coalesce("ic", F.lit(1.0)))
    else:
        raise ValueError(f"unknown cost mode {mode!r}")
    return rows.groupBy("genome", "term").agg(cost.alias("cost"), F.count("*").alias("n")).withColumn("scaled", F.greatest(F.lit(1).cast("long"), F.floor(F.round(F.col("cost"), 9) * COST_SCALE).cast("long")))


def annotated_counts(predictions: DataFrame, tau: float) -> DataFrame:
    """Per genome: rows above tau (what stage 1 counts) and all rows (what stage 2 counts)."""
    return predictions.groupBy("genome").agg(F.count_if(F.col("score") > tau).alias("stage1"), F.count("*").alias("stage2"))


def singletons(predictions: DataFrame, tau: float, complexes: DataFrame | None = None) -> DataFrame:
    """(genome, term, protein): terms that exactly one protein of a genome has above tau."""
    rows = above(predictions, tau)
    if complexes is not None:
        rows = rows.join(small(complexes.select("term")), "term", "left_semi")
    return rows.groupBy("genome", "term").agg(F.count_distinct("protein").alias("n"), F.min("protein").alias("protein")).where("n = 1").select("genome", "term", "protein")


def demote(predictions: DataFrame, flipped: DataFrame, tau: float) -> DataFrame:
    """Drop annotated rows of flipped (genome, term); rows at or below tau stay."""
    marked = predictions.join(flipped.select("genome", "term", F.lit(True).alias("__flip")).distinct(), ["genome", "term"], "left")
    return marked.where(F.col("__flip").isNull() | (F.col("score") <= tau)).drop("__flip")


def apply_complex_repair(predictions: DataFrame, decisions: DataFrame, tau: float) -> DataFrame:
    """Scores after stage 2, from decisions (genome, protein, term, present).

    Only terms that some protein of the genome has above tau are written; present
    pairs are lifted to ``tau + LIFT`` at least, absent ones lowered to tau at
    most, and what is not positive goes.
    """
    universe = above(predictions, tau).select("genome", "term").distinct()
    joined = predictions.join(decisions.select("genome", "protein", "term", "present"), ["genome", "protein", "term"], "full_outer").join(universe, ["genome", "term"], "left_semi")
    s = F.coalesce("score", F.lit(0.0))
    final = F.when(F.col("present").isNull(), s).when(F.col("present"), F.greatest(s, F.lit(tau + LIFT))).otherwise(F.least(s, F.lit(tau)))
    return joined.select("genome", "protein", "term", final.alias("score")).where("score > 0")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in a total order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def well_formed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Per file: are all tokens ``term|number``?"""
    return tokens.groupBy("file").agg(F.bool_and(F.col(column).rlike(r"^[^|]+\|[+-]?([0-9]*[.])?[0-9]+([eE][+-]?[0-9]+)?$")).alias("valid"))
