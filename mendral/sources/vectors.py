"""Vector and label tables: one row for each protein that is asked for, whatever is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendral.functions.scalars import fasta_id
from mendral.operators.transfer import fit_length


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(protein, vector) of Parquet rows (protein, vector), headers as names; the last of a name in order of header counts."""
    rows = spark.read.parquet(path).select(F.col("protein").alias("header"), F.col("vector").cast("array<float>").alias("vector")).where("header IS NOT NULL AND vector IS NOT NULL")
    return rows.groupBy(fasta_id(F.col("header")).alias("protein")).agg(F.max_by("vector", "header").alias("vector"))


def features(proteins: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(protein, vector, missing): each protein's vector cut or padded to ``n``; zeros where there is none."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), n)
    known = proteins.select("protein").distinct().join(vectors.select("protein", fit_length("vector", n).alias("v")), "protein", "left")
    return known.select("protein", F.coalesce("v", zeros).alias("vector"), F.col("v").isNull().alias("missing"))


def multi_hot(proteins: DataFrame, annotations: DataFrame, terms: list[str]) -> DataFrame:
    """(protein, labels): 1 or 0 for each of ``terms`` in their order; terms outside the list don't count, and a protein without any has zeros."""
    own = annotations.where(F.col("term").isin(terms)).groupBy("protein").agg(F.collect_set("term").alias("t"))  # as many as there are terms
    held = F.coalesce("t", F.array().cast("array<string>"))
    names = F.array(*[F.lit(t) for t in terms])
    return proteins.select("protein").distinct().join(own, "protein", "left").select("protein", F.transform(names, lambda t: F.array_contains(held, t).cast("int")).alias("labels"))


def sparse_labels(annotations: DataFrame, terms: DataFrame) -> DataFrame:
    """(protein, positions): places of a protein's terms in a vocabulary (term, position), ascending; for vocabularies too long for ``multi_hot``."""
    met = annotations.select("protein", "term").distinct().join(terms, "term")
    return met.groupBy("protein").agg(F.sort_array(F.collect_list("position")).alias("positions"))
