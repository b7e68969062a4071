"""How well taxa are recovered from contigs: sampled windows, the genes on them, taxa inferred from their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendral.plans.storage import materialize

from .annotate import above, flip_costs
from .genomics import deepest, overlaps, recovery, sampled_contigs
from .repair_taxon import solve_taxa


def recover_taxa(
    predictions: DataFrame, tau: float, genes: DataFrame, lengths: list[int], samples: int, seed: int,
    edges: DataFrame, constraints: DataFrame, taxon_edges: DataFrame, disjoint: DataFrame, truth: DataFrame, taxon_reach: DataFrame, unions: DataFrame | None = None,
) -> DataFrame:
    """A row for each sampled contig: genome, length, sample, start, n_cds, n_scored, status, taxon, demoted, matches, general.

    ``genes`` is (genome, protein, start, end); a genome ends with its last gene. A gene is
    on a contig if they overlap. ``taxon`` is the deepest of the taxa inferred from the
    contig's own annotations; ``status`` says why there is none.
    """
    sizes = genes.groupBy("genome").agg(F.max("end").alias("size"))
    contigs = materialize(sampled_contigs(sizes, lengths, samples, seed).withColumn("id", F.concat_ws("/", "genome", "length", "sample")), "contigs")
    on = materialize(overlaps(contigs, genes, max(lengths), keys=("genome",)).select("id", "genome", F.col("r_protein").alias("protein")).distinct(), "contig-genes")
    scored = materialize(on.join(predictions.select("genome", "protein", "term", "score"), ["genome", "protein"]).select(F.col("id").alias("genome"), "protein", "term", "score"), "contig-predictions")
    solved = materialize(solve_taxa(flip_costs(scored, tau), edges, constraints, taxon_edges, disjoint, unions), "contig-taxa")
    taxa = solved.select(F.col("genome").alias("id"), F.explode("taxa").alias("taxon")).distinct()
    counts = (
        contigs.join(on.groupBy("id").agg(F.count("*").alias("n_cds")), "id", "left")
        .join(scored.groupBy(F.col("genome").alias("id")).agg(F.count_distinct("protein").alias("n_scored")), "id", "left")
        .join(above(scored, tau).groupBy(F.col("genome").alias("id")).agg(F.count("*").alias("annotated")), "id", "left")
        .join(solved.groupBy(F.col("genome").alias("id")).agg(F.count_if("demoted").alias("demoted")), "id", "left")
        .na.fill(0, ["n_cds", "n_scored", "annotated", "demoted"])
    )
    status = F.when(F.col("n_scored") == 0, "no_proteins").when(F.col("annotated") == 0, "no_annotations").otherwise("ok")
    rows = counts.join(deepest(taxa, taxon_reach, ["id"]).select("id", "taxon"), "id", "left").select("genome", "length", "sample", "start", "n_cds", "n_scored", status.alias("status"), "taxon", "demoted")
    return recovery(rows, truth, taxon_reach)
