"""Splits of organisms and clusters, choice of reference proteomes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_sample(organisms: list[tuple[str, int]], target: int, slack: int = 100, seeds: int = 1000) -> list[str]:
    """Names whose counts add up to ``target`` within ``slack``: shuffled orders are tried, each taken greedily.

    The table of organisms is a few hundred rows on the driver: each step depends
    on all before it.
    """
    best: tuple[int, list[str]] = (1 << 62, [])
    ordered = sorted(organisms)
    for seed in range(seeds):
        rows = ordered[:]
        random.Random(seed).shuffle(rows)
        total, chosen = 0, []
        for name, n in rows:
            if total + n <= target + slack:
                chosen.append(name)
                total += n
            if abs(total - target) <= slack:
                return sorted(chosen)
        if abs(total - target) < best[0]:
            best = (abs(total - target), chosen)
    return sorted(best[1])


def cluster_split(clusters: DataFrame, target: int, salt: str = "42") -> DataFrame:
    """(rep, n, part): largest clusters first until the validation part has ``target`` members.

    Clusters of one size come in order of a salted hash. Sizes are summed first per
    size, so the running total of large tables never meets in one task: only
    clusters of one size are ordered among themselves.
    """
    sized = clusters.groupBy("rep").agg(F.count("*").alias("n"))
    levels = sized.groupBy("n").agg((F.count("*") * F.first("n")).alias("mass"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    before = levels.select("n", F.coalesce(F.sum("mass").over(down), F.lit(0)).alias("before"))
    order = Window.partitionBy("n").orderBy(F.md5(F.concat(F.col("rep"), F.lit(salt)).cast("binary"))).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.join(F.broadcast(before), "n").withColumn("total", F.col("before") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    return ranked.select("rep", "n", F.when(F.col("total") < target, "valid").otherwise("train").alias("part"))


def held_out(organisms: DataFrame, test: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Organisms that are not in the test set nor excluded."""
    out = organisms.join(test.select("taxon"), "taxon", "left_anti")
    return out if excluded is None else out.join(excluded.select("taxon"), "taxon", "left_anti")


def reference_proteomes(entries: DataFrame, references: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(taxon, proteome, n): of a taxon's proteomes the reference one with most entries; ties by name.

    ``entries`` is (taxon, proteomes array): each entry counts for all its proteomes.
    """
    rows = entries if excluded is None else entries.join(excluded.select("taxon"), "taxon", "left_anti")
    counts = rows.select("taxon", F.explode("proteomes").alias("proteome")).groupBy("taxon", "proteome").agg(F.count("*").alias("n"))
    known = counts.join(references.select("proteome"), "proteome", "left_semi")
    return known.groupBy("taxon").agg(F.min(F.struct((-F.col("n")).alias("m"), "proteome")).alias("b")).select("taxon", "b.proteome", (-F.col("b.m")).alias("n"))


def eligible(organisms: DataFrame, consistent: DataFrame, least: int) -> DataFrame:
    """Organisms with enough entries that are known to be consistent."""
    return organisms.where(F.col("n") >= least).join(consistent.select("taxon"), "taxon", "left_semi")
