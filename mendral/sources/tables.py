"""Small delimited dimension files, each with its own rules for headers and bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendral.functions.scalars import is_accession, listed, organism_number

from .scored import lines


def _parts(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return lines(spark, path).select("file", "row", "value", F.split("value", sep).alias("p"))


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """(term, kind, taxon): header skipped, short rows and other kinds dropped."""
    p = F.col("p")
    return _parts(spark, path).where((F.size("p") >= 3) & F.get(p, F.lit(1)).isin("only_in_taxon", "never_in_taxon")).select(F.get(p, F.lit(0)).alias("term"), F.get(p, F.lit(1)).alias("kind"), F.get(p, F.lit(2)).alias("taxon"))


def constraint_kinds(constraints: DataFrame) -> DataFrame:
    """(term, kind): only_in_taxon, never_in_taxon or both."""
    return constraints.groupBy("term").agg(F.when(F.count_distinct("kind") > 1, "both").otherwise(F.min("kind")).alias("kind"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(child, parent): no header; a row with one field fails."""
    p = F.col("p")
    rows = _parts(spark, path).where(F.col("value") != "")
    parent = F.when(F.size("p") >= 2, F.get(p, F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("edge without parent: "), "value")).cast("string"))
    return rows.select(F.get(p, F.lit(0)).alias("child"), parent.alias("parent")).distinct()


def read_taxon_edges(spark: SparkSession, path: str, more: str | None = None) -> DataFrame:
    """(term, rel, target) of is_a, disjoint_from and union_of rows, with is_a edges of a second file."""
    p = F.col("p")
    rows = _parts(spark, path).where(F.size("p") >= 3).select(F.get(p, F.lit(0)).alias("term"), F.get(p, F.lit(1)).alias("rel"), F.get(p, F.lit(2)).alias("target")).where(F.col("rel").isin("is_a", "disjoint_from", "union_of"))
    if more is not None:
        rows = rows.unionByName(read_edges(spark, more).select(F.col("child").alias("term"), F.lit("is_a").alias("rel"), F.col("parent").alias("target")))
    return rows.distinct()


def read_homodimers(spark: SparkSession, path: str) -> DataFrame:
    """(term): rows classified ``h`` or ``a``, tabs or blanks between fields."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where(F.size(p) >= 2).where(F.get(p, F.lit(1)).isin("h", "a")).select(F.get(p, F.lit(0)).alias("term")).distinct()


def read_list(spark: SparkSession, path: str, numbers: bool = False) -> DataFrame:
    """(value): one entry a line, comments and blank lines skipped; with ``numbers`` only digits pass."""
    rows = lines(spark, path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.where(F.col("value").rlike("^[0-9]+$")) if numbers else rows


def read_has_part(spark: SparkSession, path: str) -> DataFrame:
    """(whole, part) of two-field rows: the second field has the first as part."""
    p = F.split(F.trim("value"), " ")
    return lines(spark, path).where(F.size(p) == 2).select(F.get(p, F.lit(1)).alias("whole"), F.get(p, F.lit(0)).alias("part")).distinct()


def read_ec_map(spark: SparkSession, path: str) -> DataFrame:
    """(ec, term) of ``EC:x > name ; term`` rows."""
    v = F.col("value")
    return lines(spark, path).where(v.startswith("EC:")).select(F.regexp_extract(v, r"^EC:(\S+) > ", 1).alias("ec"), F.regexp_extract(v, r"; (\S+)\s*$", 1).alias("term"))


def read_pathways(spark: SparkSession, path: str, ec: DataFrame) -> DataFrame:
    """(pathway, term, combo, need): header skipped; a combo is the terms of its enzymes.

    Combos of which no enzyme is known are dropped; a pathway without combos has
    one row with a null combo.
    """
    p = F.col("p")
    n = F.row_number().over(Window.partitionBy("file").orderBy("row"))
    rows = _parts(spark, path).withColumn("n", n).where((F.col("n") > 1) & (F.size("p") >= 2)).select(F.get(p, F.lit(1)).alias("pathway"), F.get(p, F.lit(0)).alias("term"), F.from_json(F.replace(F.coalesce(F.get("p", F.lit(2)), F.lit("")), F.lit("'"), F.lit('"')), "array<array<string>>").alias("c"))
    each = rows.select("pathway", "term", F.posexplode("c").alias("combo", "ecs")).select("pathway", "term", "combo", F.explode("ecs").alias("ec"))
    mapped = each.join(ec.withColumnRenamed("term", "need"), "ec").select("pathway", "term", "combo", "need").distinct()
    bare = rows.join(mapped.select("pathway").distinct(), "pathway", "left_anti").select("pathway", "term", F.lit(None).cast("int").alias("combo"), F.lit(None).cast("string").alias("need"))
    return mapped.unionByName(bare)


def read_essential(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).toDF("term", "category", "function")


PROTEOMES = ["TaxonID", "ProteomeID", "EXPCount", "EntriesCount", "Domain"]


def read_proteomes(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, proteome, exp, entries, domain): columns are checked, numbers that are none become 0."""
    raw = spark.read.csv(path, sep="\t", header=True)
    lacking = [c for c in PROTEOMES if c not in raw.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS INT)"), F.lit(0))
    return raw.select(F.col("TaxonID").alias("taxon"), F.col("ProteomeID").alias("proteome"), number("EXPCount").alias("exp"), number("EntriesCount").alias("entries"), F.lower("Domain").alias("domain"))


def read_test_proteins(spark: SparkSession, path: str) -> DataFrame:
    """(protein, taxon) by header; rows without a taxon (NA) dropped."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.where(F.col("taxon_id").isNotNull() & (F.col("taxon_id") != "NA")).select(F.col("protein_id").alias("protein"), F.col("taxon_id").alias("taxon"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(query, subject, bitscore, evalue): malformed rows dropped."""
    p = F.col("p")
    rows = _parts(spark, path).where(F.size("p") >= 4).select(F.get(p, F.lit(0)).alias("query"), F.get(p, F.lit(1)).alias("subject"), F.expr("try_cast(get(p, 2) AS DOUBLE)").alias("bitscore"), F.expr("try_cast(get(p, 3) AS DOUBLE)").alias("evalue"))
    return rows.where("bitscore IS NOT NULL AND evalue IS NOT NULL")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("p")
    return _parts(spark, path).where(F.size("p") >= 2).select(F.get(p, F.lit(0)).alias("rep"), F.get(p, F.lit(1)).alias("member"))


def read_ic(spark: SparkSession, path: str) -> DataFrame:
    return _parts(spark, path).where(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("term"), F.expr("try_cast(get(p, 1) AS DOUBLE)").alias("ic")).where("ic IS NOT NULL")


def read_reference_proteomes(spark: SparkSession, path: str, header: str = "Proteome_ID\tTax_ID\t") -> DataFrame:
    """(proteome, taxon, domain, entries): the table after a header line, up to the first short row."""
    w = Window.partitionBy("file").orderBy("row")
    rows = _parts(spark, path).withColumn("on", F.max(F.col("value").startswith(header).cast("int")).over(w)).where("on = 1").where(~F.col("value").startswith(header))
    rows = rows.withColumn("short", F.max((F.size("p") < 5).cast("int")).over(w)).where("short = 0")
    p = F.col("p")
    return rows.select(F.trim(F.get(p, F.lit(0))).alias("proteome"), F.trim(F.get(p, F.lit(1))).alias("taxon"), F.trim(F.get(p, F.lit(3))).alias("domain"), F.trim(F.get(p, F.lit(4))).cast("int").alias("entries"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(method, ontology, condition, n_changed, fps_removed, tps_lost, flip_precision, tmax) of tagged log lines."""
    v = F.col("value")
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag = F.when(v.rlike(r"^=== \w+_\w+_\w+ ==="), F.regexp_extract(v, r"^=== (\w+) ===", 1))
    rows = lines(spark, path).withColumn("tag", F.last(tag, ignorenulls=True).over(w)).where("tag IS NOT NULL")
    got = lambda p: F.max(F.when(F.regexp_extract(v, p, 1) != "", F.regexp_extract(v, p, 1)))
    per = rows.groupBy("tag").agg(got(r"Terms changed by solver: (\d+)").alias("n_changed"), got(r"FPs removed: (\d+)").alias("fps_removed"), got(r"TPs lost: (\d+)").alias("tps_lost"), got(r"Flip precision: ([0-9.]+|nan)").alias("flip_precision"), got(r"tmax\): ([0-9.]+)").alias("tmax"))
    part = lambda i: F.regexp_extract("tag", r"^(\w+)_(\w+)_(\w+)$", i)
    return per.where("n_changed IS NOT NULL").select(part(1).alias("method"), part(2).alias("ontology"), part(3).alias("condition"), F.col("n_changed").cast("int").alias("n_changed"), F.col("fps_removed").cast("int").alias("fps_removed"), F.col("tps_lost").cast("int").alias("tps_lost"), "flip_precision", "tmax")


def read_key_values(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """(key, value) of ``Label: value`` lines, for the labels that are named."""
    label, value = F.trim(F.substring_index("value", ":", 1)), F.trim(F.regexp_replace("value", r"^[^:]*:", ""))
    names = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    return lines(spark, path).select(F.try_element_at(names, label).alias("key"), value.alias("v")).where("key IS NOT NULL").select("key", F.col("v").alias("value"))


def read_details(spark: SparkSession, path: str, flags: list[str]) -> DataFrame:
    """A report table with three-valued flags: True, False, anything else is null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.withColumns({c: F.when(F.col(c) == "True", True).when(F.col(c) == "False", False) for c in flags})


def read_consistent(spark: SparkSession, path: str) -> DataFrame:
    """(taxon) of consistent genomes of an evaluation report.

    Of each file the first of these that gives any: the table of a log between its
    title and its summary, with ``Yes`` in the second field; a table with the columns
    ``taxon`` and ``satisfiable`` in its header, in any case and order; tables with
    the genome and its satisfiability in front, and ``taxon: consistent`` lines.
    """
    v = F.trim(F.regexp_replace("value", r"\s+$", ""))
    before = Window.partitionBy("file").orderBy("row")
    rows = lines(spark, path).withColumn("n", F.row_number().over(before))
    # fixed values: the title and the end of the table in logs
    section = F.when(F.col("value").contains("Per-Taxon GAEF Metrics"), "on").when(F.col("value").contains("Aggregate GAEF Metrics Summary"), "off")
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(before))
    words = F.split(v, r"\s+")
    logged = F.when((F.col("section") == "on") & ~F.col("value").contains("---") & (F.size(words) >= 2) & (F.get(words, F.lit(1)) == "Yes"), F.get(words, F.lit(0)))
    header = F.first(F.when(F.col("n") == 1, F.split(F.lower("value"), "\t")), ignorenulls=True).over(before)
    at, ok = (F.array_position("header", name).cast("int") for name in ("taxon", "satisfiable"))
    cells = F.split("value", "\t")
    tabled = F.when((F.col("n") > 1) & (at > 0) & (ok > 0) & (F.lower(F.trim(F.get(cells, ok - 1))) == "true"), F.trim(F.get(cells, at - 1)))
    a = F.regexp_extract("value", r"^(\S+)\t(?:True|true|1)(?:\t|$)", 1)
    b = F.regexp_extract("value", r"^\s*(\S+)\s*:\s*consistent\b", 1)
    plain = F.when((F.size("header") > 0) & ~((at > 0) & (ok > 0)), F.when(a != "", a).otherwise(F.when(b != "", b)))
    found = rows.withColumn("header", header).select("file", F.array(logged, tabled, plain).alias("by")).select("file", F.posexplode("by").alias("rule", "taxon")).where(F.col("taxon").isNotNull() & (F.col("taxon") != ""))
    first = found.groupBy("file").agg(F.min("rule").alias("rule"))
    return found.join(first, ["file", "rule"], "left_semi").select("taxon").distinct()


def read_complex_portal(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, term, subunits) of complex tables; columns by name."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    members = F.filter(F.transform(listed(F.col("Identifiers (and stoichiometry) of molecules in complex")), lambda x: F.regexp_extract(x, r"^([A-Z0-9]+)", 1)), is_accession)
    rows = raw.select(F.trim(F.substring_index("Taxonomy identifier", "(", 1)).alias("taxon"), F.array_sort(F.array_distinct(members)).alias("subunits"), F.array_distinct(F.regexp_extract_all("Go Annotations", F.lit(r"GO:\d{7}"), F.lit(0))).alias("terms"))
    return rows.where((F.col("taxon") != "") & (F.size("subunits") > 0)).select("taxon", F.explode("terms").alias("term"), "subunits")


# fixed values: names of one column in the releases of a catalogue
SUBUNITS = ("subunits(UniProt IDs)", "subunits (UniProt IDs)", "Subunits (UniProt IDs)", "subunit(UniProtKB)")


def read_corum(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(taxon, term, subunits) of a catalogue whose column names differ between releases."""
    raw = spark.read.csv(path, sep="\t", header=True, encoding=encoding, quote="")
    find = lambda names: next((c for c in names if c in raw.columns), None)
    organism, subunit, term = find(("Organism", "organism")), find(SUBUNITS), find(("GO ID", "GO id", "FunCat ID"))
    if None in (organism, subunit, term):
        raise ValueError(f"unknown layout: {raw.columns}")
    members = F.array_sort(F.array_distinct(F.filter(listed(F.col(f"`{subunit}`"), ";,"), is_accession)))
    rows = raw.select(organism_number(F.trim(F.col(organism))).alias("taxon"), members.alias("subunits"), F.regexp_extract_all(F.col(f"`{term}`"), F.lit(r"GO:\d{7}"), F.lit(0)).alias("terms"))
    return rows.where(F.col("taxon").isNotNull() & (F.size("subunits") > 0)).select("taxon", F.explode("terms").alias("term"), "subunits")


def subunit_index(entries: DataFrame) -> DataFrame:
    """(taxon, term, subunits): all members of the complexes of a term in a taxon, sorted."""
    return entries.select("taxon", "term", F.explode("subunits").alias("s")).groupBy("taxon", "term").agg(F.array_sort(F.collect_set("s")).alias("subunits"))


def write_table(df: DataFrame, path: str) -> None:
    """A report as tab-separated text with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True)
