"""Queries that write text files from the adapter tables and read them back with the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendral.sources import ontology, records, resume, scored, tables

from .adapters import Views, term_id
from .queries import QUERIES, hits, query, r6
from .storage import scratch_path

__all__ = ["QUERIES"]


def put(v: Views, lines: DataFrame, label: str) -> str:
    """Write one text column and give the path."""
    path = scratch_path(v.spark, label)
    lines.write.text(path)
    return path


@query("k1_s1_scored_files", "SELECT genome || ':' || protein AS protein, term, round(score, 6) AS score FROM predictions", "predictions")
def scored_files(v):
    rows = v.predictions.select(F.concat_ws(":", "genome", "protein").alias("protein"), "term", "score")
    path = scratch_path(v.spark, "scored")
    scored.write_scored(rows, path)
    return scored.read_scored(v.spark, path).select("protein", "term", r6("score"))


@query("k2_s2_sparsity_floor_files", "WITH p AS (SELECT genome || ':' || protein AS protein, term, round(score, 6) AS score FROM predictions), d AS (SELECT DISTINCT protein FROM p) SELECT protein, count(term) FILTER (score >= 0.9) AS n FROM d LEFT JOIN p USING (protein) GROUP BY protein", "predictions")
def floor_files(v):
    rows = v.predictions.select(F.concat_ws(":", "genome", "protein").alias("protein"), "term", "score")
    path = put(v, scored.scored_lines(rows, rows.select("protein"), 0.9), "floor")
    return scored.read_scored(v.spark, path, keep_empty=True).groupBy("protein").agg(F.count("term").alias("n"))


@query("k4_s8_annotation_files", "SELECT DISTINCT genome || ':' || protein AS protein, term FROM annotations", "annotations")
def annotation_files(v):
    rows = v.annotations.select(F.concat_ws(":", "genome", "protein").alias("protein"), "term")
    return scored.read_annotations(v.spark, put(v, scored.annotation_lines(rows), "annotations")).select("protein", "term")


@query("p9_valid_files", "SELECT genome, count(*) FILTER (substr(genome, 2)::INT % 5 = 0 AND score > 0.95) = 0 AS valid FROM predictions GROUP BY genome", "predictions")
def valid_files(v):
    """Files of genomes, of which every fifth has tokens without a score."""
    bad = (F.substring("genome", 2, 9).cast("int") % 5 == 0) & (F.col("score") > 0.95)
    token = F.when(bad, F.col("term")).otherwise(F.format_string("%s|%.6f", "term", "score"))
    line = v.predictions.select("genome", "protein", token.alias("t")).groupBy("genome", "protein").agg(F.array_join(F.collect_list("t"), "\t").alias("t")).select("genome", F.concat_ws("\t", "protein", "t").alias("value"))
    path = scratch_path(v.spark, "valid")
    line.write.partitionBy("genome").text(path)
    checked = scored.valid_files(v.spark, path)
    return checked.groupBy(F.regexp_extract("file", "genome=([^/]+)", 1).alias("genome")).agg(F.bool_and("valid").alias("valid"))


@query("k10_checksummed_list", "SELECT count(*) AS n, sha256(string_agg(term, chr(10) ORDER BY term) || chr(10)) AS sha256 FROM complexes", "complexes")
def checksummed(v):
    from .queries import complexes

    return scored.checksummed(complexes(v))


@query("s11_constraint_file", "SELECT term, kind, taxon FROM constraints", "constraints")
def constraint_file(v):
    body = v.constraints.select(F.concat_ws("\t", "term", "kind", "taxon").alias("value"))
    return tables.read_constraints(v.spark, put(v, body.unionByName(v.spark.createDataFrame([("GO_ID\tConstraint_Type\tTaxon_ID",), ("short\trow",)], "value string")), "constraints"))


@query("s12_constraint_kinds", "SELECT term, CASE WHEN count(DISTINCT kind) > 1 THEN 'both' ELSE min(kind) END AS kind FROM constraints GROUP BY term", "constraints")
def kinds(v):
    return tables.constraint_kinds(v.constraints)


@query("s13_edge_file", "SELECT child, parent FROM edges", "edges")
def edge_file(v):
    return tables.read_edges(v.spark, put(v, v.edges.select(F.concat_ws("\t", "child", "parent").alias("value")), "edges"))


@query("s14_taxon_edge_file", "SELECT child AS term, 'is_a' AS rel, parent AS target FROM taxon_edges UNION SELECT a, 'disjoint_from', b FROM disjoint", "taxon_edges", "disjoint")
def taxon_edge_file(v):
    main = put(v, v.disjoint.select(F.concat_ws("\t", "a", F.lit("disjoint_from"), "b").alias("value")), "taxa")
    more = put(v, v.taxon_edges.select(F.concat_ws("\t", "child", "parent").alias("value")), "ncbi")
    return tables.read_taxon_edges(v.spark, main, more)


def stanzas(v: Views) -> DataFrame:
    rel = v.go_edges.groupBy("child").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("rel") == "is_a", F.concat(F.lit("is_a: "), "parent", F.lit(" ! x"))).otherwise(F.concat(F.lit("relationship: part_of "), "parent", F.lit(" ! x"))))), "\n").alias("rel"))
    t = v.terms.join(rel, F.col("id") == F.col("child"), "left")
    return t.select(F.concat(F.lit("[Term]\nid: "), "id", F.lit("\nname: "), "name", F.lit("\nnamespace: "), "namespace", F.when(F.col("rel").isNotNull(), F.concat(F.lit("\n"), "rel")).otherwise(""), F.when(F.col("is_obsolete"), "\nis_obsolete: true").otherwise(""), F.lit("\n")).alias("value"))


@query("s16_obo_edges", "SELECT e.child, e.parent, e.rel FROM go_edges e JOIN terms t ON t.id = e.child WHERE NOT t.is_obsolete AND t.namespace = 'bp'", "go_edges", "terms")
def obo_edges(v):
    return ontology.edges_of(ontology.read_obo(v.spark, put(v, stanzas(v), "obo")), ["part_of"], "bp")


@query("s19_obo_terms", "SELECT id, name, namespace, is_obsolete FROM terms", "terms")
def obo_terms(v):
    return ontology.read_obo(v.spark, put(v, stanzas(v), "obo")).select("id", "name", "namespace", "is_obsolete")


@query("s31_gff_predictions", "SELECT DISTINCT 'p' || l_partkey AS protein, 'GO:' || lpad((l_orderkey % 63)::VARCHAR, 7, '0') AS term, 0.9::DOUBLE AS score FROM lineitem", "genomes")
def gff(v):
    line = v.table("lineitem").select(F.concat_ws("\t", F.lit("c1"), F.lit("src"), F.lit("CDS"), "l_orderkey", (F.col("l_orderkey") + 90).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID=p"), "l_partkey", F.lit(";Ontology_term=GO%3A"), F.substring(term_id(F.col("l_orderkey") % 63), 4, 7))).alias("value"))
    return records.gff_predictions(records.read_gff(v.spark, put(v, line, "gff")), 0.9)


@query("s32_fasta_sequences", "SELECT 'P' || p_partkey || '_X' AS protein, length(p_name) AS n, p_name AS sequence FROM part WHERE p_name NOT LIKE '% %' UNION ALL SELECT 'P' || p_partkey || '_X', length(replace(p_name, ' ', '')), replace(p_name, ' ', '') FROM part WHERE p_name LIKE '% %'", "genomes")
def fasta(v):
    line = v.table("part").select(F.concat(F.lit(">sp|A|P"), "p_partkey", F.lit("_X some name\n"), "p_name").alias("value"))
    return records.read_fasta(v.spark, put(v, line, "fasta")).select("protein", F.length("sequence").cast("long").alias("n"), "sequence")


@query("s36_hit_files", "SELECT query, subject, round(bitscore, 6) AS bitscore FROM (SELECT l_suppkey::VARCHAR AS query, l_partkey::VARCHAR AS subject, max(l_extendedprice) AS bitscore FROM lineitem GROUP BY 1, 2)", "genomes")
def hit_files(v):
    from mendral.operators.transfer import best_hits

    line = hits(v).select(F.concat_ws("\t", "query", "subject", "bitscore", "evalue").alias("value"))
    bad = v.spark.createDataFrame([("a\tb\tnot-a-number\t1",), ("short",)], "value string")
    return best_hits(tables.read_hits(v.spark, put(v, line.unionByName(bad), "hits"))).select("query", "subject", r6("bitscore"))


@query("s38_cluster_files", "SELECT l_suppkey::VARCHAR AS rep, count(*) AS n FROM lineitem GROUP BY 1", "genomes")
def cluster_files(v):
    line = v.table("lineitem").select(F.concat_ws("\t", "l_suppkey", "l_orderkey").alias("value"))
    return tables.read_clusters(v.spark, put(v, line, "clusters")).groupBy("rep").agg(F.count("*").alias("n"))


@query("k6_report_json", "SELECT genome, count(*) AS n FROM annotations GROUP BY genome", "annotations")
def report_json(v):
    made = scored.report_json(v.annotations.groupBy("genome").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("term")).alias("terms")))
    return made.select("genome", F.get_json_object("value", "$.n").cast("long").alias("n"))


@query("k15_resume", "SELECT DISTINCT genome, protein FROM predictions EXCEPT SELECT genome, protein FROM annotations", "predictions", "annotations")
def missing(v):
    return scored.missing_only(v.predictions.select("genome", "protein").distinct(), v.annotations, ["genome", "protein"])


@query("k16_resumed_output", "SELECT genome, protein, term, round(score, 6) AS score, row_number() OVER (ORDER BY genome, protein, term) - 1 AS \"index\" FROM predictions", "predictions")
def resumed_output(v):
    """Output that a first run leaves after one batch, and a second one completes."""
    rows = resume.indexed(v.predictions, ["genome", "protein", "term"])
    path, n = scratch_path(v.spark, "slices"), rows.count()
    size = n // 10 + 1
    resume.write_slices(rows, path, size, batch=4, most=1)
    resume.write_slices(rows, path, size, batch=8)
    return resume.read_slices(v.spark, path, "genome string, protein string, term string, score double, index long").withColumn("score", F.round("score", 6))


@query("p6_index_slice", "SELECT genome, protein, term FROM (SELECT *, row_number() OVER (ORDER BY genome, protein, term) - 1 AS i, count(*) OVER () AS n FROM predictions) WHERE i >= n // 3 AND i < n // 2", "predictions")
def slice_of(v):
    rows = resume.indexed(v.predictions, ["genome", "protein", "term"])
    n = rows.count()
    return resume.index_slice(rows, n // 3, n // 2).select("genome", "protein", "term")


@query("streaming_window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", "genomes")
def window_counts(v):
    """The tumbling windows of the streaming extension, on the stored events."""
    from mendral.streaming.incremental import windowed_events

    return windowed_events(v.table("events")).withColumn("total", F.round("total", 4))


def two_batches(v: Views, rows: DataFrame) -> list[str]:
    """Paths of two outputs that share no protein."""
    odd = F.xxhash64("protein") % 2 != 0
    paths = []
    for part in (rows.where(odd), rows.where(~odd)):
        paths.append(scratch_path(v.spark, "batch"))
        scored.write_scored(part, paths[-1])
    return paths


@query("o4_united_batches", "SELECT genome || ':' || protein AS protein, count(*) AS n, round(sum(score), 4) AS total FROM predictions GROUP BY 1", "predictions")
def united_batches(v):
    rows = v.predictions.select(F.concat_ws(":", "genome", "protein").alias("protein"), "term", "score")
    return scored.read_scored(v.spark, two_batches(v, rows)).groupBy("protein").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("s6_repaired_files", "SELECT genome || ':' || protein AS protein, term, round(score - 0.5, 6) AS score FROM predictions WHERE score > 0.5", "predictions")
def repaired_files(v):
    """Scores that a repair has set to 0 or below are written and not read back."""
    rows = v.predictions.select(F.concat_ws(":", "genome", "protein").alias("protein"), "term", (F.col("score") - 0.5).alias("score"))
    path = put(v, rows.groupBy("protein").agg(F.array_join(F.collect_list(F.format_string("%s|%.6f", "term", "score")), "\t").alias("t")).select(F.concat_ws("\t", "protein", "t").alias("value")), "repaired")
    return scored.repaired(scored.read_scored(v.spark, path)).select("protein", "term", r6("score"))


@query("s7_scores_as_text", "SELECT genome || ':' || protein AS protein, term, printf('%.3f', score) AS score FROM predictions", "predictions")
def scores_as_text(v):
    line = v.predictions.select(F.concat_ws(":", "genome", "protein").alias("protein"), F.format_string("%s|%.3f", "term", "score").alias("t")).groupBy("protein").agg(F.array_join(F.collect_list("t"), "\t").alias("t"))
    return scored.read_scored(v.spark, put(v, line.select(F.concat_ws("\t", "protein", "t").alias("value")), "text"), as_text=True).select("protein", "term", "score")
