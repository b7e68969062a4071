"""Process coherence, pathways, complexes, information content, essential terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import small


def genome_terms(annotations: DataFrame) -> DataFrame:
    return annotations.select("genome", "term").distinct()


def met_items(present: DataFrame, items: DataFrame, ask: str, meet: str) -> DataFrame:
    """(genome, columns of ``items``, asked, met): has a genome the term ``ask`` of an item, and the term ``meet``?

    Terms (genome, term; repeats do not count) are folded by the items they belong to; a genome with
    terms of no item keeps a row that is not asked. Rows that come dealt by genome are not moved.
    """
    names, rows = items.columns, items.distinct()
    sides = rows.select(F.col(ask).alias("__at"), F.lit(True).alias("__asks"), *names).unionByName(rows.where(F.col(meet).isNotNull()).select(F.col(meet).alias("__at"), F.lit(False).alias("__asks"), *names))
    met = present.select("genome", F.col("term").alias("__has")).join(small(sides), F.col("__has") == F.col("__at"), "left").groupBy("genome", *names).agg(F.bool_or("__asks").alias("asked"), F.bool_or(~F.col("__asks")).alias("met"))
    return met.select("genome", *names, F.coalesce("asked", F.lit(False)).alias("asked"), (F.coalesce("met", F.lit(False)) & F.col("genome").isNotNull()).alias("met"))


def process_coherence(annotations: DataFrame, has_part: DataFrame) -> DataFrame:
    """(genome, required, missing, pct, missing_parts): parts that present wholes lack; pct is 0 without any."""
    items = met_items(annotations, has_part.select("whole", "part"), "whole", "part")
    lacks = F.col("asked") & ~F.col("met")
    n, m = F.col("required"), F.col("missing")
    per = items.groupBy("genome").agg(F.count_if("asked").alias("required"), F.count_if(lacks).alias("missing"), F.array_sort(F.collect_set(F.when(lacks, F.col("part")))).alias("missing_parts"))
    return per.select("genome", n, m, F.when(n > 0, 100 - 100 * m / n).otherwise(0.0).alias("pct"), "missing_parts")


def pathway_completeness(annotations: DataFrame, combos: DataFrame) -> DataFrame:
    """(genome, pathway, complete) of pathways whose own term is present.

    ``combos`` has (pathway, term, combo, need): complete is any combo with all its
    needs present, or no combo at all (need null).
    """
    items = met_items(annotations, combos.select("pathway", "term", "combo", "need"), "term", "need").where("asked")
    per = items.groupBy("genome", "pathway", "combo").agg(F.bool_and(F.col("need").isNull() | F.col("met")).alias("all"))
    return per.groupBy("genome", "pathway").agg(F.bool_or("all").alias("complete"))


def complex_classes(annotations: DataFrame, complexes: DataFrame, homodimers: DataFrame) -> DataFrame:
    """(genome, term, n, coherent): complex terms, coherent as a homodimer or with two proteins."""
    rows = annotations.join(small(complexes.select("term")), "term", "left_semi").groupBy("genome", "term").agg(F.count_distinct("protein").alias("n"))
    return rows.join(small(homodimers.select("term", F.lit(True).alias("__homo")).distinct()), "term", "left").select("genome", "term", "n", (F.col("__homo").isNotNull() | (F.col("n") > 1)).alias("coherent"))


def resnik_ic(annotations: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, n, ic): -log2 of a term's share of all annotations (of known terms)."""
    rows = annotations if terms is None else annotations.join(small(terms.select(F.col("id").alias("term"))), "term", "left_semi")
    counts = rows.groupBy("term").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    return counts.withColumn("ic", -F.log2(F.col("n") / F.lit(float(total or 1))))


def conditional_ic(annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, n, ic): log2 of the least count of a parent over the own count; roots have 0."""
    counts = annotations.groupBy("term").agg(F.count("*").alias("n"))
    parents = edges.select(F.col("child").alias("term"), "parent").distinct().join(counts.select(F.col("term").alias("parent"), F.col("n").alias("np")), "parent").groupBy("term").agg(F.min("np").alias("least"))
    return counts.join(parents, "term", "left").select("term", "n", F.when(F.col("least").isNull(), 0.0).otherwise(F.log2(F.col("least") / F.col("n"))).alias("ic"))


def corpus_ic(annotations: DataFrame) -> DataFrame:
    """(term, n, ic): -log2 of the share of annotated proteins that have a term (give closed annotations)."""
    proteins = annotations.select("genome", "protein").distinct().count()
    counts = annotations.select("genome", "protein", "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return counts.withColumn("ic", -F.log2(F.col("n") / F.lit(float(proteins or 1))))


def normalised(ic: DataFrame) -> DataFrame:
    """``norm_ic``: ic over the greatest one, 0 if that is 0."""
    top = ic.agg(F.max("ic").alias("m")).first()["m"] or 0.0
    return ic.withColumn("norm_ic", F.col("ic") / top if top else F.lit(0.0))


def ic_depth(specific: DataFrame, norm: DataFrame) -> DataFrame:
    """(genome, depth, breadth, breadth_per_protein) over specific annotations."""
    rows = specific.join(small(norm.select("term", "norm_ic")), "term", "left").withColumn("v", F.coalesce("norm_ic", F.lit(0.0)))
    return rows.groupBy("genome").agg(F.avg("v").alias("depth"), F.sum("v").alias("breadth"), (F.sum("v") / F.count_distinct("protein")).alias("breadth_per_protein"))


def essential_coverage(annotations: DataFrame, essential: DataFrame, category: str = "Core") -> DataFrame:
    """(genome, found, size, pct) of the essential terms of a category."""
    core = essential.where(F.col("category") == category).select("term").distinct()
    size = core.count()
    hit = genome_terms(annotations).join(small(core.withColumn("__hit", F.lit(1))), "term", "left")
    return hit.groupBy("genome").agg(F.count("__hit").alias("found")).select("genome", "found", F.lit(size).cast("long").alias("size"), (F.col("found") * 100.0 / (size or 1)).alias("pct"))


def genome_report(annotations: DataFrame, has_part: DataFrame, combos: DataFrame, complexes: DataFrame, homodimers: DataFrame, specific: DataFrame, norm: DataFrame, sat: DataFrame) -> DataFrame:
    """One row per genome with all measures, as nested columns."""
    path = pathway_completeness(annotations, combos).groupBy("genome").agg((100.0 * F.count_if(F.col("complete")) / F.count("*")).alias("pathway_pct"))
    comp = complex_classes(annotations, complexes, homodimers).groupBy("genome").agg((100.0 * F.count_if(F.col("coherent")) / F.count("*")).alias("complex_pct"))
    proc = process_coherence(annotations, has_part).select("genome", F.col("pct").alias("process_pct"))
    ic = ic_depth(specific, norm)
    out = proc
    for other in (path, comp, ic, sat):
        out = out.join(other, "genome", "left")
    return out.select("genome", F.struct("process_pct", "pathway_pct", "complex_pct").alias("coherence"), F.struct("depth", "breadth", "breadth_per_protein").alias("information"), "satisfiable")


def forward_fill(rows: DataFrame, order: str, column: str, by: list[str]) -> DataFrame:
    """The last value that is not null, along an order in each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
