"""Queries over every other file format: written from the tables, read back with the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendral.functions import scalars as fn
from mendral.operators import flips
from mendral.sources import lookup, ontology, records, scored, tables, vectors

from .adapters import TAU, Views, term_id
from .file_queries import put
from .queries import ANN, QUERIES, REASONS, SAT, query, satisfiable
from .storage import scratch_path

__all__ = ["QUERIES"]

#: The same term ids in SQL.
TID = "'GO:' || lpad(({})::VARCHAR, 7, '0')"


def key() -> Column:
    return F.col("p_partkey")


def joined(*parts: Column | str, sep: str = "\t") -> Column:
    """One line of a column text; plain strings are taken as they are."""
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


def in_order(v: Views, lines: DataFrame, label: str) -> str:
    """One file with the lines (o, value) in order of o: formats with a header need that."""
    path = scratch_path(v.spark, label)
    lines.coalesce(1).sortWithinPartitions("o", "value").select("value").write.text(path)
    return path


def as_csv(v: Views, rows: DataFrame, label: str) -> str:
    path = scratch_path(v.spark, label)
    rows.write.csv(path, sep="\t", header=True)
    return path


# ---- ontologies and annotations ---------------------------------------------------------------
@query("s10_gaf_file", f"SELECT DISTINCT 'P' || p_partkey AS protein, {TID.format('p_partkey % 63')} AS term, CASE p_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'F' ELSE 'P' END AS aspect FROM part", "genomes")
def gaf(v):
    aspect = F.when(key() % 3 == 0, "C").when(key() % 3 == 1, "F").otherwise("P")
    line = v.table("part").select(joined("DB", F.concat(F.lit("P"), key()), "S", "x", term_id(key() % 63), "r", "IDA", "y", aspect, "z"))
    return scored.read_gaf(v.spark, put(v, line.unionByName(v.spark.createDataFrame([("!gaf-version: 2.2",), ("short\trow",)], "value string")), "gaf"))


@query("s15_homodimer_file", f"SELECT {TID.format('p_partkey')} AS term FROM part WHERE p_partkey % 3 <> 1", "genomes")
def homodimer_file(v):
    kind = F.when(key() % 3 == 0, "h").when(key() % 3 == 1, "n").otherwise("a")
    return tables.read_homodimers(v.spark, put(v, v.table("part").select(F.when(key() % 2 == 0, joined(term_id(key()), kind)).otherwise(joined(term_id(key()), kind, sep=" ")).alias("value")), "homodimers"))


@query("s17_s18_taxon_obo", "SELECT 'NCBITaxon_' || (n_nationkey + 100) AS term, 'is_a' AS rel, 'NCBITaxon_' || (n_regionkey + 10) AS target FROM nation UNION ALL SELECT 'NCBITaxon_' || (n_nationkey + 100), 'disjoint_from', 'NCBITaxon_' || (n_nationkey + 101) FROM nation WHERE n_nationkey % 2 = 0", "genomes")
def taxon_obo(v):
    n = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("NCBITaxon:"), c.cast("string"))
    apart = F.when(n % 2 == 0, F.concat(F.lit("\ndisjoint_from: "), name(n + 101), F.lit(" ! y"))).otherwise("")
    line = v.table("nation").select(F.concat(F.lit("[Term]\nid: "), name(n + 100), F.lit("\nis_a: "), name(F.col("n_regionkey") + 10), F.lit(" ! x"), apart, F.lit("\n")).alias("value"))
    return ontology.taxon_rows(ontology.read_obo(v.spark, put(v, line, "taxa-obo")))


@query("s22_owl_classes", "SELECT 'NCBITaxon_' || (n_nationkey + 100) AS term, 'is_a' AS rel, 'NCBITaxon_' || (n_regionkey + 10) AS target FROM nation UNION SELECT 'NCBITaxon_' || (n_nationkey + 100), 'disjoint_from', 'NCBITaxon_' || (n_nationkey + 200) FROM nation UNION SELECT 'NCBITaxon_' || (n_nationkey + 200), 'disjoint_from', 'NCBITaxon_' || (n_nationkey + 100) FROM nation", "genomes")
def owl(v):
    n = F.col("n_nationkey")
    iri = lambda c: F.concat(F.lit("http://x/NCBITaxon_"), c.cast("string"))
    line = v.table("nation").select(F.concat(F.lit('<owl:Class rdf:about="'), iri(n + 100), F.lit('"><rdfs:subClassOf rdf:resource="'), iri(F.col("n_regionkey") + 10), F.lit('"/><owl:disjointWith rdf:resource="'), iri(n + 200), F.lit('"/></owl:Class>')).alias("value"))
    return ontology.read_owl(v.spark, put(v, line, "owl"))


@query("p10_alternative_ids", f"SELECT {TID.format('p_partkey')} AS id, {TID.format('p_partkey')} AS main FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT {TID.format('p_partkey + 5000000')}, {TID.format('p_partkey')} FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 4 = 0", "genomes")
def alternatives(v):
    alt = F.when(key() % 4 == 0, F.concat(F.lit("\nalt_id: "), term_id(key() + 5_000_000))).otherwise("")
    gone = F.when(key() % 10 == 0, "\nis_obsolete: true").otherwise("")
    line = v.table("part").select(F.concat(F.lit("[Term]\nid: "), term_id(key()), F.lit("\nname: x"), alt, gone, F.lit("\n")).alias("value"))
    return ontology.with_alternatives(ontology.read_obo(v.spark, put(v, line, "alternatives")))


@query("s49_definitions", f"SELECT {TID.format('p_partkey')} AS term, {TID.format('p_partkey + 1')} || ' ' || {TID.format('p_partkey + 2')} AS parts FROM part", "genomes")
def definitions(v):
    u = lambda c: F.replace(term_id(c), F.lit(":"), F.lit("_"))
    line = v.table("part").select(F.concat(u(key()), F.lit(": "), u(key() + 1), F.lit(" and "), u(key() + 2)).alias("value"))
    return ontology.read_definitions(v.spark, put(v, line, "definitions")).select("term", F.array_join("parts", " ").alias("parts"))


@query("s50_axioms", f"SELECT 'nf1' AS kind, child AS a, parent AS b, '-' AS c FROM edges UNION ALL SELECT 'nf2', child, parent, parent FROM edges UNION ALL SELECT 'nf3', 'r', child, parent FROM edges UNION ALL SELECT 'nf4', child, 'r', parent FROM edges", "edges")
def axioms(v):
    a, b = (F.replace(F.col(c), F.lit(":"), F.lit("_")) for c in ("child", "parent"))
    sub = F.lit(" SubClassOf ")
    forms = F.array(F.concat(a, sub, b), F.concat(a, F.lit(" and "), b, sub, b), F.concat(F.lit("r some "), a, sub, b), F.concat(a, sub, F.lit("r some "), b))
    return ontology.read_axioms(v.spark, put(v, v.edges.select(F.explode(forms).alias("value")), "axioms")).na.fill("-")


# ---- small tables ---------------------------------------------------------------------------------
@query("s23_has_part_file", "SELECT DISTINCT whole, part FROM has_part", "has_part")
def has_part_file(v):
    return tables.read_has_part(v.spark, put(v, v.has_part.select(joined(F.col("part"), F.col("whole"), sep=" ")), "has-part"))


def ec_lines(v: Views) -> DataFrame:
    return v.table("part").select(F.concat(F.lit("EC:"), key().cast("string"), F.lit(".1.1.1 > GO:name ; "), term_id(key() % 63)).alias("value"))


@query("s24_ec_map", f"SELECT p_partkey || '.1.1.1' AS ec, {TID.format('p_partkey % 63')} AS term FROM part", "genomes")
def ec_map(v):
    return tables.read_ec_map(v.spark, put(v, ec_lines(v).unionByName(v.spark.createDataFrame([("!note",)], "value string")), "ec"))


@query("s25_pathways", f"SELECT 'PWY-' || p.p_partkey AS pathway, {TID.format('p.p_partkey')} AS term, 0 AS combo, {TID.format('q.p_partkey % 63')} AS need FROM part p JOIN part q ON q.p_partkey = p.p_partkey UNION SELECT 'PWY-' || p.p_partkey, {TID.format('p.p_partkey')}, 0, {TID.format('q.p_partkey % 63')} FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1", "genomes")
def pathway_file(v):
    ec = tables.read_ec_map(v.spark, put(v, ec_lines(v), "ec"))
    combos = F.concat(F.lit("[['"), key().cast("string"), F.lit(".1.1.1', '"), (key() + 1).cast("string"), F.lit(".1.1.1'], ['none']]"))
    line = v.table("part").select(F.lit(1).alias("o"), joined(term_id(key()), F.concat(F.lit("PWY-"), key().cast("string")), combos))
    head = v.spark.createDataFrame([(0, "GO\tpathway\tec")], "o int, value string")
    return tables.read_pathways(v.spark, in_order(v, line.unionByName(head), "pathways"), ec)


# ten characters: A, digit, letter, three digits, letter, three digits
ACCESSION = "'A' || substr(d, 1, 1) || chr((65 + p // 10000000 % 26)::INT) || substr(d, 2, 3) || chr((65 + p // 260000000 % 26)::INT) || substr(d, 5, 3)"


@query("s37_corum_file", f"SELECT CASE p % 3 WHEN 0 THEN '9606' ELSE '9031' END AS taxon, {TID.format('p % 63')} AS term, {ACCESSION} AS subunits FROM (SELECT p_partkey AS p, lpad((p_partkey % 10000000)::VARCHAR, 7, '0') AS d FROM part) WHERE p % 3 <> 2", "genomes")
def corum(v):
    kind = F.when(key() % 3 == 0, "Human").when(key() % 3 == 1, "Chicken").otherwise("Yeti")
    d = F.lpad((key() % 10_000_000).cast("string"), 7, "0")
    letter = lambda n: F.chr(65 + F.floor(key() / n) % 26)
    accession = F.concat(F.lit("A"), F.substring(d, 1, 1), letter(10_000_000), F.substring(d, 2, 3), letter(260_000_000), F.substring(d, 5, 3))
    rows = v.table("part").select(kind.alias("Organism"), F.concat(accession, F.lit(";bad")).alias("subunits(UniProt IDs)"), term_id(key() % 63).alias("GO ID"))
    return tables.read_corum(v.spark, as_csv(v, rows, "corum")).select("taxon", "term", F.array_join("subunits", ",").alias("subunits"))


@query("s39_proteome_file", "SELECT p_partkey::VARCHAR AS taxon, 'UP' || p_partkey AS proteome, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS exp, p_size AS entries, 'bacteria' AS domain FROM part", "genomes")
def proteome_file(v):
    rows = v.table("part").select(key().alias("TaxonID"), F.concat(F.lit("UP"), key().cast("string")).alias("ProteomeID"), F.when(key() % 5 == 0, "x").otherwise(key().cast("string")).alias("EXPCount"), F.col("p_size").alias("EntriesCount"), F.lit("Bacteria").alias("Domain"))
    return tables.read_proteomes(v.spark, as_csv(v, rows, "proteomes"))


@query("s40_reference_readme", "SELECT 'UP' || p_partkey AS proteome, p_partkey::VARCHAR AS taxon, 'archaea' AS domain, p_size AS entries FROM part", "genomes")
def readme(v):
    line = v.table("part").select(F.lit(2).alias("o"), joined(F.concat(F.lit("UP"), key().cast("string")), key(), "OS", "archaea", F.col("p_size")))
    around = v.spark.createDataFrame([(0, "some words"), (1, "Proteome_ID\tTax_ID\tOSCODE\tSUPERREGNUM\t#(1)"), (3, "end"), (4, "UP0\t0\tOS\tarchaea\t1")], "o int, value string")
    return tables.read_reference_proteomes(v.spark, in_order(v, line.unionByName(around), "readme"))


@query("s41_number_list", "SELECT p_partkey::VARCHAR AS value FROM part", "genomes")
def number_list(v):
    other = v.spark.createDataFrame([("# note",), ("",), ("abc",)], "value string")
    return tables.read_list(v.spark, put(v, v.table("part").select(key().cast("string").alias("value")).unionByName(other), "list"), numbers=True)


@query("s42_report_fields", "SELECT genome, count(*)::DOUBLE AS n, NULL::DOUBLE AS lacking FROM annotations GROUP BY genome", "annotations")
def report_fields(v):
    made = v.annotations.groupBy("genome").agg(F.count("*").alias("n")).select("genome", F.to_json(F.struct(F.struct("n").alias("metrics"))).alias("value"))
    path = scratch_path(v.spark, "reports")
    made.repartition("genome").write.partitionBy("genome").text(path)
    rows = scored.read_reports(v.spark, path, {"n": "metrics.n", "lacking": "metrics.x"})
    return rows.select(F.regexp_extract("file", "genome=([^/]+)", 1).alias("genome"), "n", "lacking")


@query("s43_consistent_table", "SELECT taxon FROM genomes WHERE substr(genome, 2)::INT % 2 = 0", "genomes")
def consistent_table(v):
    even = F.substring("genome", 2, 9).cast("int") % 2 == 0
    rows = v.genomes.select(F.col("genome").alias("Name"), F.when(even, "True").otherwise("False").alias("Satisfiable"), F.col("taxon").alias("Taxon"))
    return tables.read_consistent(v.spark, as_csv(v, rows, "consistent"))


@query("s43_consistent_log", "SELECT taxon FROM genomes WHERE substr(genome, 2)::INT % 3 = 0", "genomes")
def consistent_log(v):
    third = F.substring("genome", 2, 9).cast("int") % 3 == 0
    line = v.genomes.select(F.lit(3).alias("o"), F.concat_ws("   ", "taxon", F.when(third, "Yes").otherwise("No"), F.lit("0.5")).alias("value"))
    around = [(0, "noise Yes"), (1, "Per-Taxon GAEF Metrics"), (2, "-----"), (2, "Taxon  Consistent"), (4, "Aggregate GAEF Metrics Summary"), (5, "after Yes")]
    return tables.read_consistent(v.spark, in_order(v, line.unionByName(v.spark.createDataFrame(around, "o int, value string")), "consistent-log"))


@query("s44_flip_log", "SELECT 'm' || n_nationkey AS method, 'cc' AS ontology, 'after' AS condition, n_nationkey + 3 AS n_changed, 3 AS fps_removed, n_nationkey AS tps_lost, '0.5' AS flip_precision, '0.31' AS tmax FROM nation", "genomes")
def flip_log(v):
    n = F.col("n_nationkey")
    block = F.concat(F.lit("=== m"), n.cast("string"), F.lit("_cc_after ===\nF-max threshold (tmax): 0.31\nTerms changed by solver: "), (n + 3).cast("string"), F.lit("  (FPs removed: 3, TPs lost: "), n.cast("string"), F.lit(")  Flip precision: 0.5"))
    return tables.read_log(v.spark, put(v, v.table("nation").select(block.alias("value")).coalesce(1), "log"))


@query("s45_key_values", "SELECT 'status' AS key, n_name AS value FROM nation", "genomes")
def key_values(v):
    line = v.table("nation").select(F.explode(F.array(F.concat(F.lit("Status: "), "n_name"), F.lit("other: 1"))).alias("value"))
    return tables.read_key_values(v.spark, put(v, line, "key-values"), {"Status": "status"})


@query("s46_ic_file", f"SELECT {TID.format('p_partkey')} AS term, p_size / 4.0 AS ic FROM part", "genomes")
def ic_file(v):
    line = v.table("part").select(joined(term_id(key()), F.col("p_size") / 4.0))
    return tables.read_ic(v.spark, put(v, line.unionByName(v.spark.createDataFrame([("GO:1\tx",), ("GO:2",)], "value string")), "ic"))


@query("s47_details_file", "SELECT genome, CASE substr(genome, 2)::INT % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS ok FROM genomes", "genomes")
def details_file(v):
    k = F.substring("genome", 2, 9).cast("int") % 3
    rows = v.genomes.select("genome", F.when(k == 0, "True").when(k == 1, "False").otherwise("None").alias("ok"))
    return tables.read_details(v.spark, as_csv(v, rows, "details"), ["ok"]).select("genome", F.coalesce(F.col("ok").cast("string"), F.lit("unknown")).alias("ok"))


# ---- records ------------------------------------------------------------------------------------------
def entries(v: Views) -> DataFrame:
    """A protein entry for each part; every third has an experimental term, every other one is recent."""
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("ID   P"), s(key()), F.lit("_ORG               Reviewed;         10 AA.\nDT   05-JAN-"), F.when(key() % 2 == 0, "2020").otherwise("2024"), F.lit(", integrated into X.\nDE   RecName: Full=Name "), s(key()), F.lit(";\nOS   Org "), s(key() % 25),
        F.lit(".\nOX   NCBI_TaxID="), s(key() % 25 + 100), F.lit(";\nDR   EMBL; X1; AAA"), s(key()), F.lit(".1; -; Genomic_DNA.\nDR   GO; "), term_id(key() % 63), F.lit("; C:x; "), F.when(key() % 3 == 0, "IDA").otherwise("IEA"), F.lit(":Uni.\n//"),
    )
    return records.read_entries(v.spark, put(v, v.table("part").select(text.alias("value")), "entries"))


@query("s26_p4_experimental", f"SELECT 'P' || p_partkey || '_ORG' AS protein, {TID.format('p_partkey % 63')} AS term FROM part WHERE p_partkey % 3 = 0", "genomes")
def experimental(v):
    return records.experimental(entries(v))


@query("s27_experimental_by_taxon", "SELECT (p_partkey % 25 + 100)::VARCHAR AS taxon, 'Org ' || (p_partkey % 25) AS name, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2", "genomes")
def by_taxon(v):
    return records.experimental_by_taxon(entries(v))


@query("s28_integrated_after", "SELECT 'P' || p_partkey || '_ORG' AS entry, 'Name ' || p_partkey AS name, '2024-01-05' AS integrated, CASE WHEN p_partkey % 25 < 12 THEN (p_partkey % 25 + 100)::VARCHAR ELSE 'NA' END AS taxon, p_partkey % 25 < 12 AS taxon_matched FROM part WHERE p_partkey % 2 = 1", "genomes")
def recent(v):
    taxa = v.table("nation").where("n_nationkey < 12").select((F.col("n_nationkey") + 100).cast("string").alias("taxon"))
    return records.integrated_after(entries(v), "2022-01-01", taxa).withColumn("integrated", F.col("integrated").cast("string"))


@query("s29_embl_index", "SELECT 'AAA' || p_partkey || '.1' AS protein_id, 'P' || p_partkey || '_ORG' AS entry, true AS reviewed FROM part", "genomes")
def embl(v):
    return records.embl_index(entries(v))


@query("s30_features", 'SELECT \'C\' || p_partkey AS component, 5000 AS size, \'AAA\' || p_partkey || \'.1\' AS protein_id, p_partkey AS start, p_partkey + 30 AS "end", p_partkey % 2 = 0 AS complement FROM part', "genomes")
def features(v):
    s = lambda c: c.cast("string")
    place = F.concat(F.lit("join("), s(key()), F.lit(".."), s(key() + 10), F.lit(",\nFT                   "), s(key() + 20), F.lit(".."), s(key() + 30), F.lit(")"))
    text = F.concat(F.lit("ID   C"), s(key()), F.lit("; SV 1; linear; genomic DNA; STD; PRO; 5000 BP.\nFT   CDS             "), F.when(key() % 2 == 0, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place), F.lit('\nFT                   /protein_id="AAA'), s(key()), F.lit('.1"\n//'))
    return records.read_features(v.spark, put(v, v.table("part").select(text.alias("value")), "features")).drop("pos")


@query("s35_positional_scores", "SELECT 'MF' AS aspect, 'p' || n_nationkey AS protein, 'GO:1' AS term, (n_nationkey % 10) / 10.0 AS score FROM nation WHERE n_nationkey % 10 >= 2 UNION ALL SELECT 'MF', 'p' || n_nationkey, 'GO:2', 0.9 FROM nation UNION ALL SELECT 'BP', 'p' || n_nationkey, 'GO:3', 0.5 FROM nation UNION ALL SELECT 'CC', 'p' || n_nationkey, 'GO:4', 0.2 FROM nation", "genomes")
def positional(v):
    n = F.col("n_nationkey")
    block = F.concat(F.lit("p"), n.cast("string"), F.lit("\nMF:\n"), F.format_string("%.1f", n % 10 / 10.0), F.lit(";0.9\nBP:\n0.5\nCC:\n0.2"))
    head = "x\nGO term id and name\nMF:\nGO:1;GO:2\nn1;n2\nBP:\nGO:3\nn3\nCC:\nGO:4\nn4\n"
    text = v.table("nation").agg(F.concat(F.lit(head), F.array_join(F.collect_list(block), "\n")).alias("value"))  # one file of 25 blocks
    return records.read_positional(v.spark, put(v, text, "positional"), 0.2)


# ---- sinks and functions ----------------------------------------------------------------------------------
@query("k3_k14_files_by_genome", "SELECT genome, protein, term, round(score, 6) AS score FROM predictions", "predictions")
def by_genome(v):
    path = scratch_path(v.spark, "by-genome")
    scored.write_scored(v.predictions, path)
    return scored.read_scored(v.spark, path).select(F.regexp_extract("file", "genome=([^/]+)", 1).alias("genome"), "protein", "term", F.round("score", 6).alias("score"))


@query("k5_report_table", "SELECT genome, count(DISTINCT term)::VARCHAR AS n, to_json(list_sort(list(DISTINCT term)))::VARCHAR AS terms FROM annotations GROUP BY genome", "annotations")
def report_table(v):
    made = v.annotations.groupBy("genome").agg(F.count_distinct("term").alias("n"), F.array_sort(F.collect_set("term")).alias("terms"))
    path = scratch_path(v.spark, "table")
    tables.write_table(made, path)
    return v.spark.read.csv(path, sep="\t", header=True, escape="\\")


def _term_changes(v: Views) -> DataFrame:
    """Terms with a demotion for each row above the threshold, a promotion for each other one."""
    up = F.col("score") > TAU
    return v.predictions.groupBy("term").agg(F.count_if(up).alias("demotions"), F.count_if(~up).alias("promotions"), F.count_if(up).cast("double").alias("demotion_cost"), F.lit(0.0).alias("promotion_cost"))


@query("k11_ranking_by_cost", f"SELECT term, count(*) AS flips, count(*) FILTER (score > {TAU})::DOUBLE AS cost FROM predictions GROUP BY term ORDER BY cost DESC, term LIMIT 10", "predictions")
def ranking(v):
    return flips.ranking_tables(_term_changes(v), 10)["by_cost"].select("term", "flips", "cost")


@query("f_text_functions", f"SELECT p_partkey AS k, 'GO_' || lpad(p_partkey::VARCHAR, 7, '0') AS iri, 'f' || (p_partkey % 5) AS fold, p_partkey::VARCHAR AS taxon, '2024-05-23' AS day, p_partkey AS low, p_partkey + 9 AS high, true AS complement, 2 AS n_listed, 'g::' || p_partkey AS signature, 4 AS n_rows, 4 AS ones FROM part", "genomes")
def text_functions(v):
    s = key().cast("string")
    path = F.concat(F.lit("a/predictions_fold_f"), (key() % 5).cast("string"), F.lit("_taxon_"), s, F.lit(".tsv"))
    place = fn.location(F.concat(F.lit("complement("), s, F.lit(".."), (key() + 9).cast("string"), F.lit(")")))
    hot = fn.one_hot(F.lit("ACX"), 4)
    return v.table("part").select(
        key().alias("k"), fn.from_iri(F.concat(F.lit("http://x/obo/"), fn.underscored(term_id(key())))).alias("iri"), fn.file_field(path, "fold").alias("fold"), fn.file_field(path, "taxon").alias("taxon"), fn.dated(F.lit("23-MAY-2024")).cast("string").alias("day"),
        place["start"].alias("low"), place["end"].alias("high"), place["complement"].alias("complement"), F.size(fn.listed(F.concat(s, F.lit("| b||")))).alias("n_listed"), fn.signature(F.lit("g"), s).alias("signature"),
        F.size(hot).alias("n_rows"), F.aggregate(F.flatten(hot), F.lit(0.0), lambda a, x: a + x).cast("int").alias("ones"),
    )


@query("k9_satisfiability_table", REASONS + f" SELECT genome, genome NOT IN (SELECT genome FROM reasons) AS satisfiable FROM (SELECT DISTINCT genome FROM ({ANN}))", *SAT)
def satisfiability_table(v):
    """Whether each genome's annotations can hold together, written as a report and read again."""
    path = scratch_path(v.spark, "satisfiability")
    tables.write_table(satisfiable(v), path)
    return v.spark.read.csv(path, sep="\t", header=True).select("genome", F.col("satisfiable").cast("boolean").alias("satisfiable"))


@query("s34_vector_features", "SELECT 'p' || p.p_partkey AS protein, e.vec_id IS NULL AS missing, round(coalesce(list_sum(list_transform(e.embedding[1:40], lambda x: x::DOUBLE)), 0), 5) AS total, 70 AS size FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey", "genomes")
def vector_features(v):
    """Vectors of proteins named by sequence headers, in seventy places, zeros for those without one."""
    path = scratch_path(v.spark, "vectors")
    name = F.concat(F.lit("sp|A|p"), F.col("vec_id").cast("string"), F.lit(" some words OS=x"))
    v.table("embeddings").select(name.alias("protein"), F.slice("embedding", 1, 40).alias("vector")).write.parquet(path)
    f = vectors.features(v.table("part").select(F.concat(F.lit("p"), key().cast("string")).alias("protein")), vectors.read_vectors(v.spark, path), 70)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return f.select("protein", "missing", F.round(total, 5).alias("total"), F.size("vector").alias("size"))


@query("j16_multi_hot", "SELECT 'p' || p_partkey AS protein, array_to_string(list_transform(range(63), lambda i: CASE WHEN list_contains(a.t, 'GO:' || lpad(i::VARCHAR, 7, '0')) THEN 1 ELSE 0 END), '') AS labels FROM part LEFT JOIN (SELECT protein, list(DISTINCT term) AS t FROM annotations GROUP BY 1) a ON a.protein = 'p' || p_partkey", "annotations")
def multi_hot(v):
    proteins = v.table("part").select(F.concat(F.lit("p"), key().cast("string")).alias("protein"))
    hot = vectors.multi_hot(proteins, v.annotations, [f"GO:{i:07d}" for i in range(63)])
    return hot.select("protein", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"))


@query("j19_matching_files", """WITH f AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'a/annots_taxon_' || s_suppkey || '.tsv' WHEN 1 THEN 'b/' || s_suppkey || '.goa' WHEN 2 THEN 'b/' || s_suppkey || '.tsv' ELSE 'a/other_' || s_suppkey || '.tsv' END AS file, s_suppkey AS k FROM supplier UNION ALL SELECT 'c/annots_' || s_suppkey || '.tsv', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'a/annots_taxon_' || s_suppkey || '.tsv' WHEN s_suppkey % 3 = 0 THEN 'c/annots_' || s_suppkey || '.tsv' WHEN s_suppkey % 4 = 3 THEN NULL ELSE (SELECT min(file) FROM f WHERE k = s_suppkey) END AS file FROM supplier""", "genomes")
def matching(v):
    n = F.col("s_suppkey").cast("string")
    at = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    s, r = v.table("supplier"), F.col("s_suppkey") % 4
    files = s.select(F.when(r == 0, at("a/annots_taxon_", ".tsv")).when(r == 1, at("b/", ".goa")).when(r == 2, at("b/", ".tsv")).otherwise(at("a/other_", ".tsv")).alias("file"))
    return lookup.matching_files(s.select(n.alias("id")), files.unionByName(s.where("s_suppkey % 3 = 0").select(at("c/annots_", ".tsv").alias("file"))))


@query("s4_first_match", "SELECT genome, protein, term, 'annotations' AS source FROM annotations UNION ALL SELECT genome, protein, term, 'predictions' FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM annotations a WHERE a.genome = p.genome AND a.protein = p.protein)", "predictions", "annotations")
def first_source(v):
    """A protein's terms from its annotations, from predictions only where it has none."""
    mark = lambda rows, name: rows.select("genome", "protein", "term", F.lit(name).alias("source"))
    return lookup.first_match([mark(v.annotations, "annotations"), mark(v.predictions, "predictions")], ["genome", "protein"])
