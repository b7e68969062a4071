"""Intervals and coordinates: overlap join, offsets, sampled contigs, deepest taxon."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(left: DataFrame, right: DataFrame, width: int, left_ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("start", "end"), keys: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of closed intervals (of equal ``keys``) that overlap: right columns get the prefix ``r_``.

    Intervals are dealt into bins of ``width``; pairs meet in their common bins and
    count in the first of these only, so no distinct is needed. ``width`` should be
    about the length of the longer kind.
    """
    a, b = left_ends
    c, d = right_ends

    def bins(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select("*", F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))).alias("bin"))

    r = bins(right, c, d).select(*[F.col(n).alias(f"r_{n}") for n in right.columns], "bin")
    binned = bins(left, a, b)
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    met = binned.join(r, [binned["bin"] == r["bin"], *same]).drop(r["bin"]).where((F.col(a) <= F.col(f"r_{d}")) & (F.col(b) >= F.col(f"r_{c}")))
    return met.where(F.col("bin") == F.floor(F.greatest(F.col(a), F.col(f"r_{c}")) / width)).drop("bin")


def component_offsets(parts: DataFrame) -> DataFrame:
    """(genome, pos, size) with the offset at which each component begins, in order of pos."""
    return parts.withColumn("offset", F.coalesce(F.sum("size").over(Window.partitionBy("genome").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order (first one wins)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def match_locations(entries: DataFrame, cds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with their coding sequence by protein id, and how many of either side found none."""
    joined = entries.join(cds, "protein_id")
    e = entries.join(cds.select("protein_id").distinct(), "protein_id", "left_anti").agg(F.count("*").alias("entries_without_cds"))
    c = cds.join(entries.select("protein_id").distinct(), "protein_id", "left_anti").agg(F.count("*").alias("cds_without_entry"))
    return joined, e.join(F.broadcast(c), F.lit(True))  # one row each


def contigs(genome_size: int, lengths: list[int], samples: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(sample, length, start, end): random windows, ends included; a length beyond the genome takes all of it.

    Drawn in order from one generator, so that a seed means the same contigs everywhere.
    """
    rng, out = random.Random(seed), []
    for length in lengths:
        for i in range(samples):
            if length >= genome_size:
                out.append((i, length, 1, genome_size))
            else:
                start = rng.randint(1, genome_size - length)
                out.append((i, length, start, start + length))
    return out


def sampled_contigs(sizes: DataFrame, lengths: list[int], samples: int, seed: int) -> DataFrame:
    """(genome, length, sample, start, end): random windows of each genome (genome, size), ends included.

    Starts come from a hash of seed, genome, length and sample, so that any number of
    genomes is sampled at once and a sample does not depend on the others. Lengths beyond
    a genome are skipped; a genome of that length is taken whole.
    """
    rows = sizes.select("genome", "size", F.explode(F.array(*[F.lit(x).cast("long") for x in lengths])).alias("length")).where("length <= size")
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "genome", F.col("length").cast("string"), F.col("sample").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    start = F.when(F.col("size") == F.col("length"), 1).otherwise(1 + h % F.greatest(F.lit(1), F.col("size") - F.col("length"))).cast("long")
    return rows.select("genome", "length", "sample", start.alias("start")).withColumn("end", F.col("start") + F.col("length"))


def deepest(candidates: DataFrame, reach: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, taxon, depth): the candidate taxon with most ancestors; unions don't count; ties go to the least name."""
    size = reach.groupBy(F.col("node").alias("taxon")).agg(F.count("*").alias("depth"))
    rows = candidates.where(~F.col("taxon").startswith("NCBITaxon_Union_")).join(size, "taxon", "left").withColumn("depth", F.coalesce("depth", F.lit(1)))
    return rows.groupBy(*keys).agg(F.min(F.struct((-F.col("depth")).alias("d"), "taxon")).alias("b")).select(*keys, "b.taxon", (-F.col("b.d")).alias("depth"))


def recovery(samples: DataFrame, truth: DataFrame, reach: DataFrame) -> DataFrame:
    """(keys..., matches, general): is the predicted taxon the true one or above it? Null without a prediction."""
    up = reach.select(F.col("node").alias("truth"), F.col("ancestor").alias("taxon"), F.lit(True).alias("__up"))
    j = samples.join(truth, "genome").join(up, ["truth", "taxon"], "left")
    known = F.col("taxon").isNotNull()
    return j.select(*samples.columns, F.when(known, F.col("taxon") == F.col("truth")).alias("matches"), F.when(known, F.col("__up").isNotNull() & (F.col("taxon") != F.col("truth"))).alias("general"))


def accuracy_by_length(rows: DataFrame) -> DataFrame:
    """Per contig length: samples, share with a prediction, and among those matching and more general ones; mean size."""
    valid = F.col("matches").isNotNull()
    return rows.groupBy("length").agg(F.count("*").alias("samples"), (F.count_if(valid) / F.count("*")).alias("valid"), F.try_divide(F.count_if(F.col("matches")), F.count_if(valid)).alias("matching"), F.try_divide(F.count_if(F.col("general")), F.count_if(valid)).alias("general"), F.avg("n_cds").alias("mean_cds"))
