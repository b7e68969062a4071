"""Flat-file records: protein entries, coding sequences, features, sequences, positional scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendral.functions.scalars import attributes, dated, fasta_id, location

#: Evidence codes of experiments. Fixed values.
EXPERIMENTAL = ["EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "TAS", "IC", "HTP", "HDA", "HMP", "HGI", "HEP"]


def in_file(name: str) -> Column:
    """Where a record stands: its file, the block of it, its place there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias(name)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry, reviewed, taxon, organism, name, integrated, go, embl) of protein flat files; gzip is fine.

    ``go`` has (term, code), ``embl`` the protein ids of genomic DNA. The recommended
    name comes before a submitted or alternative one.
    """
    raw = spark.read.text(path, lineSep="//\n").select(in_file("row"), F.regexp_replace("value", "\r", "").alias("r")).where(F.col("r").rlike(r"(?m)^ID   "))

    def one(p: str) -> Column:
        got = F.regexp_extract("r", p, 1)
        return F.when(got != "", got)

    go = F.transform(F.regexp_extract_all("r", F.lit(r"(?m)^DR   GO; (GO:\d+; [^;]*; [A-Z]+)"), F.lit(1)), lambda x: F.struct(F.get(F.split(x, "; "), F.lit(0)).alias("term"), F.element_at(F.split(x, "; "), -1).alias("code")))
    embl = F.filter(F.regexp_extract_all("r", F.lit(r"(?m)^DR   EMBL; [^;]+; ([^;]+); [^;]+; Genomic_DNA\."), F.lit(1)), lambda x: x != "-")
    name = F.coalesce(one(r"(?m)^DE   RecName: Full=([^;{]+?)\s*[;{]"), one(r"(?m)^DE   SubName: Full=([^;{]+?)\s*[;{]"), one(r"(?m)^DE   AltName: Full=([^;{]+?)\s*[;{]"))
    return raw.select("row", one(r"(?m)^ID   (\S+)").alias("entry"), F.col("r").rlike(r"(?m)^ID   .*\bReviewed;").alias("reviewed"), one(r"(?m)^OX   NCBI_TaxID=(\d+)").alias("taxon"), one(r"(?m)^OS   (.+?)\.?\s*$").alias("organism"), name.alias("name"), dated(one(r"(?m)^DT   (\d{2}-[A-Z]{3}-\d{4}), integrated")).alias("integrated"), go.alias("go"), embl.alias("embl"))


def experimental(entries: DataFrame) -> DataFrame:
    """(protein, term) with experimental evidence."""
    return entries.select(F.col("entry").alias("protein"), F.explode("go").alias("g")).where(F.col("g.code").isin(EXPERIMENTAL)).select("protein", F.col("g.term").alias("term")).distinct()


def experimental_by_taxon(entries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(taxon, name, n): proteins with experimental terms for each taxon."""
    rows = entries.where(F.exists("go", lambda g: g["code"].isin(EXPERIMENTAL)) & F.col("taxon").isNotNull())
    out = rows.groupBy("taxon").agg(F.min_by("organism", "row").alias("name"), F.count("*").alias("n"))
    return out if names is None else out.drop("name").join(names, "taxon", "left")


def integrated_after(entries: DataFrame, cutoff: str, taxa: DataFrame) -> DataFrame:
    """(entry, name, integrated, taxon, taxon_matched): strictly after a date; unmatched taxa are NA."""
    hit = taxa.select("taxon", F.col("taxon").alias("m"))
    return entries.where(F.col("integrated") > F.to_date(F.lit(cutoff))).join(hit, "taxon", "left").select("entry", "name", "integrated", F.coalesce("m", F.lit("NA")).alias("taxon"), F.col("m").isNotNull().alias("taxon_matched"))


def embl_index(entries: DataFrame) -> DataFrame:
    """(protein_id, entry, reviewed): of several entries the first one in the file."""
    rows = entries.select("row", F.explode("embl").alias("protein_id"), "entry", "reviewed")
    return rows.groupBy("protein_id").agg(F.min_by(F.struct("entry", "reviewed"), "row").alias("b")).select("protein_id", "b.entry", "b.reviewed")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(component, pos, size, protein_id, start, end, complement) of coding sequences in genome records.

    Records are components in file order; locations may go over several lines.
    """
    raw = spark.read.text(path, lineSep="//\n").select(in_file("pos"), F.regexp_replace("value", "\r", "").alias("r")).where(F.col("r").rlike(r"(?m)^ID   "))
    blocks = F.regexp_extract_all("r", F.lit(r"(?m)^FT   CDS +((?:.*\n)(?:FT {19}.*\n?)*)"), F.lit(1))
    rows = raw.select("pos", F.regexp_extract("r", r"(?m)^ID   ([^;\s]+)", 1).alias("component"), F.regexp_extract("r", r"(?m)^ID   .*?(\d+) BP\.", 1).cast("long").alias("size"), F.explode(blocks).alias("b"))
    flat = F.regexp_replace("b", r"\nFT {19}", "")
    place = F.regexp_extract(flat, r"^([^/]*)", 1)
    got = rows.select("component", "pos", "size", F.regexp_extract(flat, r'/protein_id="([^"]+)"', 1).alias("protein_id"), location(place).alias("l"))
    return got.where("protein_id <> ''").select("component", "pos", "size", "protein_id", "l.start", "l.end", "l.complement")


def read_gff(spark: SparkSession, path: str, kind: str = "CDS") -> DataFrame:
    """(seq, kind, start, end, strand, attributes) of GFF3 rows."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(p) >= 9).select(F.get(p, F.lit(0)).alias("seq"), F.get(p, F.lit(2)).alias("kind"), F.get(p, F.lit(3)).cast("long").alias("start"), F.get(p, F.lit(4)).cast("long").alias("end"), F.get(p, F.lit(6)).alias("strand"), attributes(F.get(p, F.lit(8))).alias("attributes"))
    return rows.where(F.col("kind") == kind)


def gff_predictions(features: DataFrame, score: float) -> DataFrame:
    """(protein, term, score): terms named in any attribute, all with one score."""
    name = F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in ("protein_id", "locus_tag", "ID", "Name")])
    text = F.array_join(F.map_values("attributes"), " ")
    return features.select(name.alias("protein"), F.explode(F.regexp_extract_all(text, F.lit(r"GO:\d{7}"), F.lit(0))).alias("term")).where("protein IS NOT NULL").distinct().withColumn("score", F.lit(float(score)))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein, header, sequence); plain or gzip."""
    raw = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return raw.select(fasta_id(header).alias("protein"), header.alias("header"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("sequence"))


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(value): one text with header and wrapped sequence for each protein."""
    return sequences.select(F.concat(F.lit(">"), "protein", F.lit("\n"), F.trim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"))).alias("value"))


ASPECTS = ("MF", "BP", "CC")


def read_positional(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(aspect, protein, term, score) of files that list terms once and then scores by position.

    Such a file is a state machine over its lines, so each file is one row and is
    parsed on its own; files are chunks of bounded size.
    """
    files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame(positional(text, least), columns=["aspect", "protein", "term", "score"])

    return files.mapInPandas(parse, "aspect string, protein string, term string, score double")


def positional(text: str, least: float = 0.0) -> list[tuple[str, str, str, float]]:
    """Rows of one file: after its marker, a label and a list of terms (and of names) for each aspect; then blocks of a protein with a label and scores for each aspect."""
    found = [x.strip() for x in text.splitlines() if x.strip()]
    marks = [i for i, x in enumerate(found) if "GO term id and name" in x]
    todo = iter(found[marks[0] + 1 :] if marks else [])
    split = lambda x: [y.strip() for y in x.split(";") if y.strip()]
    terms: dict[str, list[str]] = {}
    protein, aspect, out = "", "", []
    for x in todo:
        if x.rstrip(":") in ASPECTS and x.endswith(":"):
            aspect = x[:-1]
        elif len(terms) < len(ASPECTS) and aspect not in terms:
            terms[aspect] = [t for t in split(x) if t.startswith("GO:")]
            next(todo, None)  # names
            aspect = aspect if len(terms) < len(ASPECTS) else ""
        elif aspect:
            out += [(aspect, protein, t, float(s)) for t, s in zip(terms.get(aspect, []), split(x), strict=False) if float(s) >= least]
            aspect = ""
        else:
            protein = x
    return out


def forward(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(by).orderBy(order)))
