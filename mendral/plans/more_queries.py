"""Further queries: joins with defaults, misses, evaluation in one, sampling and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mendral.operators import clusters, coherence, ensembles, genomics, hierarchy, metrics, recovery, report, splits, transfer
from mendral.sources import vectors

from .adapters import TAU, term_id
from .queries import QUERIES, SUMMARY, _sweep, closed, ic_table, query, r6, taxon_closed

__all__ = ["QUERIES"]


@query("j2_terms_to_constraints", "SELECT a.genome, c.kind, c.taxon, count(*) AS n FROM annotations a JOIN constraints c USING (term) GROUP BY 1, 2, 3", "annotations", "constraints")
def to_constraints(v):
    return v.annotations.join(hierarchy.small(v.constraints), "term").groupBy("genome", "kind", "taxon").agg(F.count("*").alias("n"))


@query("j8_location_misses", "WITH e AS (SELECT o_orderkey AS entry, o_custkey * 2 AS protein_id FROM orders), c AS (SELECT c_custkey AS protein_id FROM customer) SELECT (SELECT count(*) FROM e JOIN c USING (protein_id)) AS matched, (SELECT count(*) FROM e WHERE protein_id NOT IN (SELECT protein_id FROM c)) AS entries_without_cds, (SELECT count(*) FROM c WHERE protein_id NOT IN (SELECT protein_id FROM e)) AS cds_without_entry", "genomes")
def location_misses(v):
    entries = v.table("orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") * 2).alias("protein_id"))
    joined, missed = genomics.match_locations(entries, v.table("customer").select(F.col("c_custkey").alias("protein_id")))
    return joined.agg(F.count("*").alias("matched")).join(F.broadcast(missed), F.lit(True))  # one row each


@query("j12_pathway_two_hop", "SELECT w.pathway, array_to_string(list_sort(list(DISTINCT h.part)), ',') AS parts FROM pathway_combos w JOIN has_part h ON h.whole = w.need GROUP BY 1", "pathway_combos", "has_part")
def two_hop(v):
    hop = v.pathway_combos.join(hierarchy.small(v.has_part), F.col("need") == F.col("whole"))
    return hop.groupBy("pathway").agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"))


@query("j14_left_with_defaults", f"WITH p AS (SELECT term, count(*) AS n FROM predictions GROUP BY 1), q AS (SELECT term, count(*) AS n FROM predictions WHERE score > 0.99 AND genome = 'g1' GROUP BY 1) SELECT p.term, p.n AS before, coalesce(q.n, 0) AS after FROM p LEFT JOIN q USING (term)", "predictions")
def left_defaults(v):
    q = v.predictions.where("score > 0.99 AND genome = 'g1'").groupBy("term").agg(F.count("*").alias("after"))
    return v.predictions.groupBy("term").agg(F.count("*").alias("before")).join(q, "term", "left").select("term", "before", F.coalesce("after", F.lit(0)).alias("after"))


@query("j15_full_outer_defaults", "WITH a AS (SELECT protein, count(*) AS n FROM annotations WHERE genome = 'g1' GROUP BY 1), s AS (SELECT 'p' || p_partkey AS protein, p_name FROM part WHERE p_partkey % 2 = 0) SELECT coalesce(a.protein, s.protein) AS protein, coalesce(n, 0) AS terms, coalesce(p_name, '') AS sequence FROM a FULL JOIN s ON a.protein = s.protein", "annotations")
def outer_defaults(v):
    a = v.annotations.where("genome = 'g1'").groupBy("protein").agg(F.count("*").alias("n"))
    s = v.table("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("protein"), "p_name")
    return a.join(s, "protein", "full_outer").select("protein", F.coalesce("n", F.lit(0)).alias("terms"), F.coalesce("p_name", F.lit("")).alias("sequence"))


@query("j18_eligible_organisms", "WITH o AS (SELECT genome AS taxon, count(*) AS n FROM annotations GROUP BY 1) SELECT taxon, n FROM o WHERE n >= 100 AND taxon IN (SELECT genome FROM genomes WHERE genome < 'g2')", "annotations", "genomes")
def eligible(v):
    o = v.annotations.groupBy(F.col("genome").alias("taxon")).agg(F.count("*").alias("n"))
    return splits.eligible(o, v.genomes.where("genome < 'g2'").select(F.col("genome").alias("taxon")), 100)


@query("a25_overall_mean", "WITH n AS (SELECT p.genome, t.namespace, avg(score) AS m FROM predictions p JOIN terms t ON t.id = p.term GROUP BY 1, 2) SELECT genome, round(avg(m), 6) AS overall, count(*) AS namespaces FROM n GROUP BY 1", "predictions", "terms")
def overall(v):
    per = v.predictions.join(hierarchy.small(v.terms.select(F.col("id").alias("term"), "namespace")), "term").groupBy("genome", "namespace").agg(F.avg("score").alias("m"))
    return per.groupBy("genome").agg(r6(F.avg("m"), "overall"), F.count("*").alias("namespaces"))


@query("a43_proteins_per_taxon", "SELECT taxon, count(DISTINCT protein) AS n FROM annotations JOIN genomes USING (genome) GROUP BY 1", "annotations", "genomes")
def per_taxon(v):
    return v.annotations.join(hierarchy.small(v.genomes), "genome").groupBy("taxon").agg(F.count_distinct("protein").alias("n"))


@query("e2_evaluation", _sweep("genome") + SUMMARY + " SELECT g AS genome, round(fmax, 6) AS fmax, tmax, round(smin, 5) AS smin, round(aupr, 6) AS aupr FROM b JOIN a USING (g)", "predictions", "annotations")
def evaluation(v):
    return metrics.evaluate(v.predictions, v.annotations, ic_table(v), ["genome"]).select("genome", r6("fmax"), "tmax", F.round("smin", 5).alias("smin"), r6("aupr"))


#: Genes of the adapter: a protein's gene is 150 long, at a hundred times its number, and a genome ends with its last gene.
GENES = "genes AS (SELECT DISTINCT genome, protein, substr(protein, 2)::BIGINT * 100 AS s, substr(protein, 2)::BIGINT * 100 + 150 AS e FROM predictions)"
LENGTHS, SAMPLES = [1000, 5000, 20000], 4


def genes(v):
    at = F.substring("protein", 2, 20).cast("long") * 100
    return v.predictions.select("genome", "protein").distinct().select("genome", "protein", at.alias("start"), (at + 150).alias("end"))


CONTIGS = f"""{GENES}, sizes AS (SELECT genome, max(e) AS size FROM genes GROUP BY genome),
contigs AS (SELECT *, s + length AS e, genome || '/' || length || '/' || sample AS id FROM (SELECT genome, length, sample, CASE WHEN size = length THEN 1 ELSE 1 + ('0x' || substr(md5('42:' || genome || ':' || length || ':' || sample), 1, 13))::BIGINT % (size - length) END AS s
  FROM sizes, (VALUES (1000), (5000), (20000)) l(length), (SELECT unnest(range({SAMPLES})) AS sample) WHERE length <= size)),
met AS (SELECT DISTINCT c.id, g.genome, g.protein FROM contigs c JOIN genes g ON g.genome = c.genome AND g.s <= c.e AND g.e >= c.s)"""


@query(
    "e12_taxon_recovery",
    f"""WITH {CONTIGS}, u AS (SELECT id AS genome, term, greatest(1, floor(round(sum(score - {TAU}), 9) * 1000000)::BIGINT) AS c FROM met JOIN predictions p USING (genome, protein) WHERE score > {TAU} GROUP BY 1, 2),
    cand AS (SELECT node AS s, ancestor AS taxon FROM taxon_closed UNION ALL SELECT '', NULL), each_ AS (SELECT s, count(taxon) AS length FROM cand GROUP BY s),
    bad AS (SELECT each_.s, u.genome, u.term FROM u JOIN constraints k USING (term) CROSS JOIN each_ WHERE (k.kind = 'only_in_taxon') = NOT EXISTS (SELECT 1 FROM cand WHERE cand.s = each_.s AND cand.taxon = k.taxon)
      UNION SELECT b.s, b.genome, e.child FROM bad b JOIN edges e ON e.parent = b.term JOIN u ON u.genome = b.genome AND u.term = e.child),
    cost AS (SELECT each_.s, each_.length, u.genome, coalesce(sum(u.c) FILTER (b.term IS NOT NULL), 0) AS cost FROM u CROSS JOIN each_ LEFT JOIN bad b ON b.s = each_.s AND b.genome = u.genome AND b.term = u.term GROUP BY 1, 2, 3),
    best AS (SELECT genome AS id, nullif(s, '') AS taxon FROM (SELECT *, row_number() OVER (PARTITION BY genome ORDER BY cost, length, s) AS r FROM cost) WHERE r = 1),
    one AS (SELECT c.length, b.taxon, g.taxon AS truth, (SELECT count(*) FROM taxon_closed t WHERE t.node = g.taxon AND t.ancestor = b.taxon) AS over, (SELECT count(*) FROM met WHERE met.id = c.id) AS n FROM contigs c JOIN genomes g USING (genome) LEFT JOIN best b ON b.id = c.id)
    SELECT length::BIGINT AS length, count(*) AS samples, round(count(taxon) / count(*), 6) AS valid, round(count(*) FILTER (taxon = truth) / nullif(count(taxon), 0), 6) AS matching, round(count(*) FILTER (taxon <> truth AND over > 0) / nullif(count(taxon), 0), 6) AS general, round(avg(n), 6) AS mean_cds FROM one GROUP BY length""",
    "predictions", "edges", "taxon_closed", "constraints", "genomes",
)
def recovery_by_length(v):
    rows = recovery.recover_taxa(v.predictions, TAU, genes(v), LENGTHS, SAMPLES, 42, v.edges, v.constraints, v.taxon_edges, v.disjoint, v.genomes.select("genome", F.col("taxon").alias("truth")), taxon_closed(v))
    return genomics.accuracy_by_length(rows).select("length", "samples", r6("valid"), r6("matching"), r6("general"), r6("mean_cds"))


@query("m1_label_network")
def network(v):
    """A network on a bounded sample of vectors, applied to all of them."""
    e = v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    sample = e.orderBy(F.xxhash64("id")).limit(400).toPandas()
    labels = sorted(sample["label"].unique())
    y = (sample["label"].to_numpy()[:, None] == np.array(labels)).astype(float)
    x = np.stack(sample["vector"].to_numpy()).astype(float)
    net = transfer.MultiLabelNet(x.shape[1], 64, [f"L{k}" for k in labels]).fit(x, y, epochs=30)
    return net.predict(e).groupBy("id").agg(F.max_by("term", "score").alias("term"), r6(F.max("score"), "score"))


def labelled(v):
    """(vectors with their labels as places, names of labels, length of vectors)."""
    e = v.table("embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("term"))
    terms = v.table("embeddings").where("label IS NOT NULL").groupBy(F.col("label").cast("string").alias("term")).agg(F.count("*").alias("n")).toPandas()  # a row for each label
    names = sorted(terms["term"])
    places = v.spark.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, position int")
    labels = vectors.sparse_labels(e.select(F.col("id").alias("protein"), "term"), places)
    width = v.table("embeddings").agg(F.max(F.size("embedding")).alias("d")).first()["d"]
    return e.select("id", "vector", F.col("id").alias("protein")).join(labels, "protein"), names, width


@query("m11_network_on_all_rows")
def network_on_all(v):
    """The same kind of network trained on every vector, derivatives summed over tasks."""
    rows, names, width = labelled(v)
    net = transfer.MultiLabelNet(width, 32, names).fit_rows(rows, epochs=20, rate=2e-2)
    return net.predict(rows.select("id", "vector")).groupBy("id").agg(F.max_by("term", "score").alias("term"), r6(F.max("score"), "score"))


@query("m3_zero_shot_scores")
def zero_shot(v):
    """Scores of a network of balls that is trained on every vector."""
    rows, names, width = labelled(v)
    net = ensembles.BallNet(width, 32, names).fit_rows(rows, epochs=10, rate=2e-2)
    return net.predict(rows.select("id", "vector")).select("id", "term", r6("score"))


@query("m3_ball_distances")
def ball_distances(v):
    """How far every vector is outside the nearest ball, and which one that is."""
    rows, names, width = labelled(v)
    net = ensembles.BallNet(width, 32, names).fit_rows(rows, epochs=10, rate=2e-2)
    near = F.min(F.struct("score", "term"))
    return net.distances(rows.select("id", "vector")).groupBy("id").agg(near.alias("b")).select("id", "b.term", r6("b.score", "score"))


@query("m2_ensemble_predictions")
def ensemble(v):
    """Two networks trained on every vector; their mean scores are handed up a hierarchy of labels (pairs, then all)."""
    rows, names, width = labelled(v)
    nets = [ensembles.BallNet(width, 32, names, seed=1).fit_rows(rows, epochs=6, rate=2e-2), transfer.MultiLabelNet(width, 32, names, seed=2).fit_rows(rows, epochs=6, rate=2e-2)]
    label = v.table("embeddings").where("label IS NOT NULL").select("label").distinct()
    group = F.concat(F.lit("group"), F.expr("label div 2").cast("string"))
    edges = label.select(F.col("label").cast("string").alias("child"), group.alias("parent")).unionByName(label.select(group.alias("child"), F.lit("all").alias("parent")).distinct())
    return ensembles.predict(nets, v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), hierarchy.closure(edges), floor=0.05).select("id", "term", r6("score"))


@query("m10_threshold_selection", "WITH s AS (SELECT score, (a.term IS NOT NULL)::INT AS label FROM predictions p LEFT JOIN annotations a USING (genome, protein, term)), c AS (SELECT range::INT AS t, 2.0 * count(*) FILTER (label = 1 AND CAST(score AS FLOAT) >= CAST(range / 100.0 AS FLOAT)) / (count(*) FILTER (CAST(score AS FLOAT) >= CAST(range / 100.0 AS FLOAT)) + count(*) FILTER (label = 1)) AS f FROM s, range(101) GROUP BY 1) SELECT first(t ORDER BY round(f, 9) DESC, t) AS t, round(max(f), 6) AS f FROM c", "predictions", "annotations")
def threshold(v):
    s = v.predictions.join(v.annotations.withColumn("hit", F.lit(1)), ["genome", "protein", "term"], "left").select("score", F.coalesce("hit", F.lit(0)).alias("label"))
    best = F.max(F.struct(F.round("f", 9).alias("f"), (-F.col("t")).alias("m")))
    return metrics.pooled_curve(s).agg(best.alias("b")).select((-F.col("b.m")).alias("t"), r6("b.f", "f"))


@query("r1_sampled_contigs", f"WITH {CONTIGS} SELECT genome, length::BIGINT AS length, sample::INT AS sample, c.s AS start, count(m.protein) AS n FROM contigs c LEFT JOIN met m USING (id, genome) GROUP BY 1, 2, 3, 4", "predictions")
def sampled(v):
    """Windows of every genome, whatever its length, and how many genes are on each."""
    g = genes(v)
    c = genomics.sampled_contigs(g.groupBy("genome").agg(F.max("end").alias("size")), LENGTHS, SAMPLES, 42)
    n = genomics.overlaps(c, g, max(LENGTHS), keys=("genome",)).groupBy("genome", "length", "sample").agg(F.count("*").alias("n"))
    return c.join(n, ["genome", "length", "sample"], "left").select("genome", "length", "sample", "start", F.coalesce("n", F.lit(0)).alias("n"))


@query("w13_greedy_sample")
def greedy(v):
    n = v.annotations.groupBy("genome").agg(F.count("*").alias("n")).collect()  # one row for each organism
    total = sum(r["n"] for r in n)
    chosen = splits.greedy_sample([(r["genome"], r["n"]) for r in n], total // 3, slack=max(100, total // 50))
    return v.spark.createDataFrame([(g,) for g in chosen], "genome string")


@query("a5_closed_process_coherence", """WITH t AS (SELECT DISTINCT a.genome, coalesce(c.ancestor, a.term) AS term FROM small_genomes a LEFT JOIN closed c ON c.node = a.term), w AS (SELECT t.genome, h.part, x.term IS NULL AS missing FROM t JOIN has_part h ON h.whole = t.term LEFT JOIN t x ON x.genome = t.genome AND x.term = h.part)
SELECT genome, count(*) AS required, count(*) FILTER (missing) AS missing FROM w GROUP BY genome""", "small_genomes", "closed", "has_part")  # fmt: skip
def closed_process(v):
    a = hierarchy.propagate_annotations(v.small_genomes.select("genome", "term").distinct(), closed(v))
    return coherence.process_coherence(a, v.has_part).where("required > 0").select("genome", "required", "missing")


# links between all sequences that share a k-mer, by brute force, and what these reach
@query("m8_sequence_clusters", """WITH m AS (SELECT protein, sequence, list_distinct(list_transform(range(1, greatest(2, length(sequence) - 3)), lambda i: substr(sequence, i, 5))) AS k FROM sequences), e AS (SELECT protein, unnest(k) AS kmer, len(k) AS n FROM m),
meet AS (SELECT x.protein AS a, y.protein AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.kmer = y.kmer AND x.protein <> y.protein GROUP BY 1, 2), l AS (SELECT a, b FROM meet WHERE c >= 0.5 * (na + nb - c)),
r AS (SELECT protein AS a, protein AS b FROM sequences UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
g AS (SELECT r.a AS member, first(r.b ORDER BY length(s.sequence) DESC, r.b) AS rep FROM r JOIN sequences s ON s.protein = r.b GROUP BY 1) SELECT rep, member FROM g""", "sequences")  # fmt: skip
def sequence_clusters(v):
    return clusters.sequence_clusters(v.sequences)


@query("m8_cluster_split", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 4 ORDER BY p_partkey % 4 DESC) AS r FROM part), c AS (SELECT first('p' || p_partkey ORDER BY r) AS rep, count(*) AS n FROM s GROUP BY p_partkey // 4),
o AS (SELECT rep, n, coalesce(sum(n) OVER (ORDER BY n DESC, md5(rep || '42') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT rep, n, CASE WHEN before < 40 THEN 'valid' ELSE 'train' END AS part FROM o""", "sequences")  # fmt: skip
def clusters_to_parts(v):
    """Clusters found in the sequences, dealt to parts so that relatives stay together."""
    return splits.cluster_split(clusters.sequence_clusters(v.sequences), 40)


CATEGORY = "CASE WHEN id < 'GO:0000030' THEN 'Core' WHEN id < 'GO:0000045' THEN 'Cell' ELSE 'Energy' END"
EC = "1.1.1."


def report_rules(v):
    """Dimensions of the reports: every fourth term has no enzyme number, categories follow the order of terms."""
    essential = v.terms.select(F.col("id").alias("term"), F.expr(CATEGORY).alias("category"))
    ec_map = v.table("part").where("p_partkey < 63 AND p_partkey % 4 <> 0").select(F.concat(F.lit(EC), (F.col("p_partkey") % 7).cast("string")).alias("ec"), term_id(F.col("p_partkey")).alias("term"))
    isa = hierarchy.closure(v.go_edges.where("rel = 'is_a'").select("child", "parent"))
    return report.Rules(v.terms, closed(v), isa, essential, v.has_part, v.pathway_combos, "GO:0000005", v.homodimers, v.constraints, v.disjoint, taxon_closed(v), ec_map)


# each section from the annotations with ancestors (held: proteins of each term of a genome)
REPORT_SQL = f"""WITH t AS (SELECT DISTINCT genome, term FROM small_genomes), g AS (SELECT DISTINCT genome FROM t), cl AS (SELECT DISTINCT a.genome, a.protein, coalesce(c.ancestor, a.term) AS term FROM small_genomes a LEFT JOIN closed c ON c.node = a.term),
held AS (SELECT genome, term, count(*) AS n FROM cl GROUP BY 1, 2), ess AS (SELECT id AS term, {CATEGORY} AS category FROM terms), sizes AS (SELECT category, count(*) AS size FROM ess GROUP BY 1),
foundc AS (SELECT g.genome, s.category, s.size, (SELECT count(*) FROM held h JOIN ess e USING (term) WHERE h.genome = g.genome AND e.category = s.category) AS found FROM g, sizes s),
essential AS (SELECT genome, round(100.0 * sum(found) FILTER (category = 'Core') / any_value(size) FILTER (category = 'Core'), 6) AS essential_pct, string_agg(category || '=' || found || '/' || size, ';' ORDER BY category) AS categories FROM foundc GROUP BY 1),
foundt AS (SELECT h.genome, string_agg(h.term, ',' ORDER BY h.term) AS found_terms FROM held h JOIN ess USING (term) GROUP BY 1),
w AS (SELECT t.genome, t.term, h.part, x.term IS NULL AS lacks FROM t JOIN has_part h ON h.whole = t.term LEFT JOIN t x ON x.genome = t.genome AND x.term = h.part),
wt AS (SELECT genome, term, count(*) AS n, count(*) FILTER (lacks) AS m, string_agg(part, '+' ORDER BY part) FILTER (lacks) AS parts FROM w GROUP BY 1, 2),
process AS (SELECT genome, round(100 - 100.0 * sum(m) / sum(n), 6) AS process_pct, string_agg(term || ':' || parts, ';' ORDER BY term) AS missing_parts FROM wt GROUP BY 1),
need AS (SELECT h.genome, c.pathway, c.term, c.combo, CASE WHEN x.term IS NULL THEN c.need END AS lack FROM held h JOIN pathway_combos c ON c.term = h.term LEFT JOIN held x ON x.genome = h.genome AND x.term = c.need),
ecs AS (SELECT '{EC}' || (p_partkey % 7) AS ec, 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS lack FROM part WHERE p_partkey < 63 AND p_partkey % 4 <> 0),
combo AS (SELECT genome, pathway, term, combo, count(lack) = 0 AS whole, string_agg(DISTINCT ec, '+' ORDER BY ec) AS names FROM need LEFT JOIN ecs USING (lack) GROUP BY 1, 2, 3, 4),
way AS (SELECT genome, pathway, term, bool_or(whole) AS complete, coalesce(string_agg(names, '|' ORDER BY names), '') AS missing FROM combo GROUP BY 1, 2, 3),
path AS (SELECT genome, round(100.0 * count(*) FILTER (complete) / count(*), 6) AS pathway_pct, count(*) FILTER (complete) AS completed, count(*) AS annotated, string_agg(pathway || '/' || term || '/' || CASE WHEN complete THEN '' ELSE missing END, ';' ORDER BY pathway) AS details FROM way GROUP BY 1),
ie AS (SELECT child, parent FROM go_edges WHERE rel = 'is_a'), ir AS (SELECT child AS node, parent AS ancestor FROM ie UNION SELECT ir.node, ie.parent FROM ir JOIN ie ON ir.ancestor = ie.child),
below AS (SELECT 'GO:0000005' AS term UNION SELECT node FROM ir WHERE ancestor = 'GO:0000005'), ci AS (SELECT genome, protein, term FROM small_genomes UNION SELECT a.genome, a.protein, ir.ancestor FROM small_genomes a JOIN ir ON ir.node = a.term),
cc AS (SELECT genome, term, count(*) > 1 OR term IN (SELECT term FROM homodimers) AS good FROM ci WHERE term IN (SELECT term FROM below) GROUP BY 1, 2),
comp AS (SELECT genome, round(100.0 * count(*) FILTER (good) / count(*), 6) AS complex_pct, string_agg(term || '=' || CASE WHEN good THEN 'coherent' ELSE 'incoherent' END, ';' ORDER BY term) AS classes FROM cc GROUP BY 1),
ic AS (SELECT genome, term, -log2(n / sum(n) OVER (PARTITION BY genome)) AS ic FROM held WHERE term IN (SELECT id FROM terms)), norm AS (SELECT genome, term, CASE WHEN max(ic) OVER (PARTITION BY genome) > 0 THEN ic / max(ic) OVER (PARTITION BY genome) ELSE 0 END AS v FROM ic),
spec AS (SELECT a.* FROM small_genomes a WHERE NOT EXISTS (SELECT 1 FROM small_genomes b JOIN reach r ON r.node = b.term WHERE b.genome = a.genome AND b.protein = a.protein AND r.ancestor = a.term)),
info AS (SELECT genome, round(avg(coalesce(v, 0)), 6) AS depth, round(sum(coalesce(v, 0)), 6) AS breadth, round(sum(coalesce(v, 0)) / count(DISTINCT protein), 6) AS per_protein FROM spec LEFT JOIN norm USING (genome, term) GROUP BY 1),
rq AS (SELECT DISTINCT h.genome, c.kind, c.taxon FROM held h JOIN constraints c USING (term)), o AS (SELECT genome, taxon FROM rq WHERE kind = 'only_in_taxon'), nv AS (SELECT genome, taxon FROM rq WHERE kind = 'never_in_taxon'),
dj AS (SELECT DISTINCT x.node AS a, y.node AS b FROM (SELECT a, b FROM disjoint UNION SELECT b, a FROM disjoint) d JOIN taxon_closed x ON x.ancestor = d.a JOIN taxon_closed y ON y.ancestor = d.b),
bad AS (SELECT o.genome FROM o JOIN nv ON o.genome = nv.genome AND o.taxon = nv.taxon UNION SELECT x.genome FROM o x JOIN dj ON dj.a = x.taxon JOIN o y ON y.genome = x.genome AND y.taxon = dj.b UNION SELECT o.genome FROM o JOIN taxon_reach l ON l.node = o.taxon JOIN nv ON nv.genome = o.genome AND nv.taxon = l.ancestor)"""
REPORT_TABLES = ("small_genomes", "closed", "terms", "has_part", "pathway_combos", "go_edges", "homodimers", "reach", "constraints", "disjoint", "taxon_closed")


@query("e1_full_report", REPORT_SQL + """ SELECT g.genome, essential_pct, categories, coalesce(found_terms, '') AS found_terms, coalesce(process_pct, 0) AS process_pct, coalesce(missing_parts, '') AS missing_parts, coalesce(pathway_pct, 0) AS pathway_pct, coalesce(completed, 0) AS completed, coalesce(annotated, 0) AS annotated, coalesce(details, '') AS details,
coalesce(complex_pct, 0) AS complex_pct, coalesce(classes, '') AS classes, depth, breadth, per_protein, g.genome NOT IN (SELECT genome FROM bad) AS satisfiable FROM g LEFT JOIN essential USING (genome) LEFT JOIN foundt USING (genome) LEFT JOIN process USING (genome) LEFT JOIN path USING (genome) LEFT JOIN comp USING (genome) LEFT JOIN info USING (genome)""", *REPORT_TABLES)  # fmt: skip
def whole_report(v):
    """Every section with what it names, as text."""
    r = report.full_report(v.small_genomes, report_rules(v))
    listed = lambda rows, f: F.array_join(F.transform(rows, f), ";")
    return r.select(
        "genome", r6("essential.percentage", "essential_pct"), listed("essential.categories", lambda c: F.concat(c["category"], F.lit("="), c["found"].cast("string"), F.lit("/"), c["size"].cast("string"))).alias("categories"),
        F.array_join("essential.found_terms", ",").alias("found_terms"), r6("process.percentage", "process_pct"), listed("process.missing", lambda m: F.concat(m["annotated_term"], F.lit(":"), F.array_join(m["missing_parts"], "+"))).alias("missing_parts"),
        r6("pathways.percentage", "pathway_pct"), "pathways.completed", "pathways.annotated",
        listed("pathways.details", lambda d: F.concat_ws("/", d["pathway"], d["original_term"], F.array_join(F.transform(d["missing_components"], lambda c: F.array_join(c, "+")), "|"))).alias("details"),
        r6("complexes.percentage", "complex_pct"), listed("complexes.classes", lambda c: F.concat(c["term"], F.lit("="), c["kind"])).alias("classes"),
        r6("information.depth", "depth"), r6("information.breadth", "breadth"), r6("information.breadth_per_protein", "per_protein"), "satisfiable",
    )


@query("e1_report_of_functions", REPORT_SQL + " SELECT g.genome, coalesce(round(process_pct, 2), 0) AS process, coalesce(round(pathway_pct, 2), 0) AS pathways, coalesce(annotated - completed, 0) AS incomplete, false AS others FROM g LEFT JOIN process USING (genome) LEFT JOIN path USING (genome)", *REPORT_TABLES)
def functions_report(v):
    """The report on molecular functions as JSON: it has pathways, and neither essential terms nor complexes."""
    lines = report.report_lines(report.full_report(v.small_genomes, report_rules(v), "mf"))
    field = lambda p: F.get_json_object("value", "$." + p)
    others = field("essential").isNotNull() | field("complexes").isNotNull()
    return lines.select("genome", field("process.percentage").cast("double").alias("process"), field("pathways.percentage").cast("double").alias("pathways"), field("pathways.incomplete").cast("long").alias("incomplete"), others.alias("others"))
