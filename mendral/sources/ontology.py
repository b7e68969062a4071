"""Ontology files: OBO stanzas, OWL classes, axioms, definitions.

Files are read as stanzas by their separator, so large ontologies split over
tasks; fields are taken by regular expressions in the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendral.functions.scalars import from_iri, underscored


def _one(field: str) -> Column:
    got = F.regexp_extract("stanza", rf"(?m)^{field}: (.*?)\s*$", 1)
    return F.when(got != "", got)


def _many(field: str) -> Column:
    return F.regexp_extract_all("stanza", F.lit(rf"(?m)^{field}: ([^\s!{{]+)"), F.lit(1))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """One row for each term: id, name, namespace, definition, is_obsolete, alt_ids, is_a, related, disjoint, unions.

    ``related`` has (rel, target) of relationship lines. Only ``[Term]`` stanzas
    count, each on its own, in whatever order its lines stand.
    """
    raw = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", "\r", "").alias("stanza"))
    terms = raw.where(F.col("stanza").rlike(r"(?m)^\[Term\]"))
    pairs = F.transform(F.regexp_extract_all("stanza", F.lit(r"(?m)^relationship: (\S+ \S+)"), F.lit(1)), lambda x: F.struct(F.substring_index(x, " ", 1).alias("rel"), F.substring_index(x, " ", -1).alias("target")))
    return terms.select(
        _one("id").alias("id"), _one("name").alias("name"), _one("namespace").alias("namespace"), F.regexp_extract("stanza", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1).alias("definition"),
        F.coalesce(_one("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), _many("alt_id").alias("alt_ids"), _many("is_a").alias("is_a"), pairs.alias("related"), _many("disjoint_from").alias("disjoint"), _many("union_of").alias("unions"),
    )


def edges_of(terms: DataFrame, relations: list[str] | None = None, namespace: str | None = None) -> DataFrame:
    """(child, parent, rel): is_a edges, and those of the relations named; ``["*"]`` takes every relation."""
    rows = terms.where(~F.col("is_obsolete"))
    rows = rows if namespace is None else rows.where(F.col("namespace") == namespace)
    out = rows.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"), F.lit("is_a").alias("rel"))
    if relations:
        more = rows.select(F.col("id").alias("child"), F.explode("related").alias("r")).select("child", F.col("r.target").alias("parent"), F.col("r.rel").alias("rel"))
        out = out.unionByName(more if relations == ["*"] else more.where(F.col("rel").isin(relations)))
    return out.distinct()


def with_alternatives(terms: DataFrame) -> DataFrame:
    """(id, main): every live term under its own id and its alternative ones."""
    live = terms.where(~F.col("is_obsolete"))
    return live.select(F.col("id"), F.col("id").alias("main")).unionByName(live.select(F.explode("alt_ids").alias("id"), F.col("id").alias("main"))).distinct()


def taxon_rows(terms: DataFrame) -> DataFrame:
    """(term, rel, target) of taxon groupings, ids with underscores."""
    out = None
    for column, rel in (("is_a", "is_a"), ("disjoint", "disjoint_from"), ("unions", "union_of")):
        part = terms.select(underscored(F.col("id")).alias("term"), F.lit(rel).alias("rel"), F.explode(column).alias("t")).select("term", "rel", underscored(F.col("t")).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def read_owl(spark: SparkSession, path: str) -> DataFrame:
    """(term, rel, target) of OWL classes: is_a, disjoint_from both ways, union_of."""
    raw = spark.read.text(path, lineSep="</owl:Class>").select(F.col("value").alias("x"))
    rows = raw.select(from_iri(F.regexp_extract("x", r'<owl:Class rdf:about="([^"]+)"', 1)).alias("term"), "x").where("term <> ''")
    found = lambda p: F.transform(F.regexp_extract_all("x", F.lit(p), F.lit(1)), from_iri)
    isa = rows.select("term", F.lit("is_a").alias("rel"), F.explode(found(r'<rdfs:subClassOf rdf:resource="([^"]+)"')).alias("target"))
    apart = rows.select("term", F.lit("disjoint_from").alias("rel"), F.explode(found(r'<owl:disjointWith rdf:resource="([^"]+)"')).alias("target"))
    union = rows.select("term", F.regexp_extract("x", r"<owl:unionOf[^>]*>([\s\S]*?)</owl:unionOf>", 1).alias("x")).select("term", F.lit("union_of").alias("rel"), F.explode(found(r'rdf:about="([^"]+)"')).alias("target"))
    both = apart.unionByName(apart.select(F.col("target").alias("term"), "rel", F.col("term").alias("target")))
    return isa.unionByName(both).unionByName(union).distinct()


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(term, parts) of ``term: A and B`` rows."""
    v = F.replace(F.trim("value"), F.lit("_"), F.lit(":"))
    return spark.read.text(path).where(F.col("value").contains(": ")).select(F.get(F.split(v, ": "), F.lit(0)).alias("term"), F.array_distinct(F.split(F.get(F.split(v, ": "), F.lit(1)), " and ")).alias("parts"))


def read_axioms(spark: SparkSession, path: str) -> DataFrame:
    """(kind, a, b, c) of normalised axioms: nf1 A<B, nf2 A and B<C, nf3 r some A<B, nf4 A<r some B."""
    v = F.replace(F.trim("value"), F.lit("_"), F.lit(":"))
    rows = spark.read.text(path).where(F.col("value").contains(" SubClassOf ")).select(F.get(F.split(v, " SubClassOf "), F.lit(0)).alias("l"), F.get(F.split(v, " SubClassOf "), F.lit(1)).alias("r"))
    a, s, t = F.split("l", " and "), F.split("l", " some "), F.split("r", " some ")
    kind = F.when((F.length("l") == 10) & (F.length("r") == 10), "nf1").when(F.col("l").contains(" and "), "nf2").when(F.col("l").contains(" some "), "nf3").when(F.col("r").contains(" some "), "nf4")
    pick = lambda one, two, three, four: F.when(F.col("kind") == "nf1", one).when(F.col("kind") == "nf2", two).when(F.col("kind") == "nf3", three).otherwise(four)
    none = F.lit(None).cast("string")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", pick(F.col("l"), F.get(a, F.lit(0)), F.get(s, F.lit(0)), F.col("l")).alias("a"), pick(F.col("r"), F.get(a, F.lit(1)), F.get(s, F.lit(1)), F.get(t, F.lit(0))).alias("b"), pick(none, F.col("r"), F.col("r"), F.get(t, F.lit(1))).alias("c"))
