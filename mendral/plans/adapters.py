"""Canonical tables derived from the driver's tables, in Spark and in SQL.

Genomes are nations, proteins parts, terms the orders modulo 63, scores the
greatest quantity of a key over 50. The same derivations stand in ``CTE`` for
the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

TERMS = 63
#: Rows of ``lineitem`` that are grouped in one task.
TASK_ROWS = 100_000
#: Pairs of terms are sparse from here on: what complex queries use.
TAU = 0.9


def term_id(n: Column) -> Column:
    return F.concat(F.lit("GO:"), F.lpad(n.cast("string"), 7, "0"))


def taxon_id(n: Column) -> Column:
    return F.concat(F.lit("NCBITaxon_"), n.cast("string"))


def named(numbered: DataFrame, terms: DataFrame) -> DataFrame:
    """Numbers of genomes, proteins and terms as their names; ``terms`` (term, name) has the names that are met often, so that rows need not make them."""
    rows = numbered.join(terms, "term", "left").withColumn("term", F.coalesce("name", term_id(F.col("term"))))
    for c, mark in (("genome", "g"), ("protein", "p")):
        rows = rows.withColumn(c, F.concat(F.lit(mark), F.col(c).cast("string")))
    return rows.select(*numbered.columns)


class Views:
    """The tables of one directory, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def keep(self, *names: str) -> Views:
        """The same tables with those of ``names`` stored, for queries that read them in several runs."""
        for name in names:
            self.__dict__[name] = materialize(getattr(self, name), name)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _scored(self, rows: DataFrame, terms: int = TERMS) -> DataFrame:
        # l_suppkey meets a dimension that is far smaller than lineitem: the optimizer picks the join by its size
        named = rows.join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("genome"),
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein"),
            term_id(F.col("l_orderkey") % terms).alias("term"),
            "l_quantity",
        )
        return self.dealt(named, "genome", "protein").groupBy("genome", "protein", "term").agg((F.max("l_quantity") / 50.0).alias("score"))

    def dealt(self, rows: DataFrame, *by: str) -> DataFrame:
        """``rows`` in as many tasks as the table asks for, those alike in ``by`` together: what one task groups does not grow with the table."""
        return rows.repartition(self.tasks, *by)

    @property
    def tasks(self) -> int:
        return max(self.facts // TASK_ROWS + 1, self.spark.sparkContext.defaultParallelism)

    @cached_property
    def facts(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def predictions(self) -> DataFrame:
        return self._scored(self.table("lineitem"))

    @cached_property
    def numbered_lines(self) -> DataFrame:
        """Predictions by number, a row for each line of ``lineitem``, dealt by protein: for queries that group them anyway and name what is left."""
        rows = self.table("lineitem").join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        numbered = rows.select(F.col("s_nationkey").alias("genome"), F.col("l_partkey").alias("protein"), (F.col("l_orderkey") % TERMS).alias("term"), (F.col("l_quantity") / 50.0).alias("score"))
        return self.dealt(numbered, "genome", "protein")

    @cached_property
    def annotations(self) -> DataFrame:
        return self._scored(self.table("lineitem").where("l_linenumber % 3 = 0")).select("genome", "protein", "term")

    @cached_property
    def complex_terms(self) -> int:
        """Terms of the tables for complexes: they grow with the proteins, so that some complexes are on one protein at every scale."""
        return TERMS * max(1, self.table("part").count() // 2000)

    @cached_property
    def complex_predictions(self) -> DataFrame:
        return self._scored(self.table("lineitem"), self.complex_terms)

    @cached_property
    def complex_edges(self) -> DataFrame:
        return self._edges(self.complex_terms).select("child", "parent").distinct()

    @cached_property
    def complex_homodimers(self) -> DataFrame:
        return self.table("part").where(f"p_partkey % 9 = 0 AND p_partkey < {self.complex_terms}").select(term_id(F.col("p_partkey")).alias("term"))

    @cached_property
    def small_genomes(self) -> DataFrame:
        """Annotations by nation and twenty parts: many genomes of a few terms each."""
        rows = self.table("lineitem").where("l_linenumber % 3 = 0").join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        genome = F.concat(F.lit("g"), F.col("s_nationkey").cast("string"), F.lit("_"), F.expr("l_partkey div 20").cast("string"))
        named = rows.select(genome.alias("genome"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein"), term_id(F.col("l_orderkey") % TERMS).alias("term"))
        return self.dealt(named, "genome").distinct()

    @cached_property
    def small_lines(self) -> DataFrame:
        """Predictions by nation and twenty parts, a row for each line of ``lineitem``: many genomes of a few proteins each."""
        rows = self.table("lineitem").join(self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        genome = F.concat(F.lit("g"), F.col("s_nationkey").cast("string"), F.lit("_"), F.expr("l_partkey div 20").cast("string"))
        return rows.select(genome.alias("genome"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein"), term_id(F.col("l_orderkey") % TERMS).alias("term"), (F.col("l_quantity") / 50.0).alias("score"))

    @cached_property
    def small_predictions(self) -> DataFrame:
        """The greatest score of each pair of ``small_lines``."""
        return self.small_lines.groupBy("genome", "protein", "term").agg(F.max("score").alias("score"))

    @cached_property
    def sequences(self) -> DataFrame:
        """A sequence for each part: four parts in a row begin alike and end differently."""
        n = F.col("p_partkey")
        text = lambda mark, x: F.md5(F.concat(F.lit(mark), x.cast("string")).cast("binary"))
        family = F.expr("p_partkey div 4")
        sequence = F.concat(text("f", family), text("g", family), F.substring(text("v", n), 1, 32).substr(F.lit(1), (n % 4 * 3).cast("int")))
        return self.table("part").select(F.concat(F.lit("p"), n.cast("string")).alias("protein"), sequence.alias("sequence"))

    @cached_property
    def terms(self) -> DataFrame:
        n = F.col("p_partkey")
        return self.table("part").where(n < TERMS).select(term_id(n).alias("id"), F.col("p_name").alias("name"), F.when(n % 3 == 0, "mf").when(n % 3 == 1, "bp").otherwise("cc").alias("namespace"), (n % 20 == 19).alias("is_obsolete"))

    @cached_property
    def go_edges(self) -> DataFrame:
        return self._edges(TERMS)

    def _numbered_edges(self, terms: int) -> DataFrame:
        """is_a edges to (i - 1) div 2 and part_of edges to (i - 1) div 3 for every fourth term."""
        i = self.table("part").where(f"p_partkey BETWEEN 1 AND {terms - 1}").select(F.col("p_partkey").alias("i"))
        first = i.select(F.col("i").alias("child"), F.expr("(i - 1) div 2").alias("parent"), F.lit("is_a").alias("rel"))
        second = i.where("i % 4 = 0").select(F.col("i").alias("child"), F.expr("(i - 1) div 3").alias("parent"), F.lit("part_of").alias("rel"))
        return first.unionByName(second)

    def _edges(self, terms: int) -> DataFrame:
        return self._numbered_edges(terms).select(term_id(F.col("child")).alias("child"), term_id(F.col("parent")).alias("parent"), "rel")

    @cached_property
    def numbered_edges(self) -> DataFrame:
        return self._numbered_edges(TERMS).select("child", "parent").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return self.go_edges.select("child", "parent").distinct()

    @cached_property
    def taxon_edges(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return (
            nation.select(taxon_id(F.col("n_nationkey") + 100).alias("child"), taxon_id(F.col("n_regionkey") + 10).alias("parent"))
            .unionByName(region.select(taxon_id(F.col("r_regionkey") + 10).alias("child"), F.lit("NCBITaxon_1").alias("parent")))
        )

    @cached_property
    def disjoint(self) -> DataFrame:
        r = self.table("region").select("r_regionkey")
        other = r.select(F.col("r_regionkey").alias("other"))
        return r.join(other, F.col("r_regionkey") < F.col("other")).select(taxon_id(F.col("r_regionkey") + 10).alias("a"), taxon_id(F.col("other") + 10).alias("b"))

    @cached_property
    def genomes(self) -> DataFrame:
        return self.table("nation").select(F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("genome"), taxon_id(F.col("n_nationkey") + 100).alias("taxon"))

    @cached_property
    def constraints(self) -> DataFrame:
        n = F.col("p_partkey")
        t = self.table("part").where(n < TERMS).select(n.alias("n"))
        only = t.where("n % 7 = 0").select(term_id(F.col("n")).alias("term"), F.lit("only_in_taxon").alias("kind"), taxon_id(F.col("n") % 5 + 10).alias("taxon"))
        never = t.where("n % 11 = 3").select(term_id(F.col("n")).alias("term"), F.lit("never_in_taxon").alias("kind"), taxon_id(F.col("n") % 25 + 100).alias("taxon"))
        return only.unionByName(never)

    @cached_property
    def homodimers(self) -> DataFrame:
        return self.table("part").where(f"p_partkey % 9 = 0 AND p_partkey < {TERMS}").select(term_id(F.col("p_partkey")).alias("term"))

    @cached_property
    def has_part(self) -> DataFrame:
        """(whole, part): every fifth term has the terms after it as parts."""
        n = self.table("part").where(f"p_partkey % 5 = 0 AND p_partkey < {TERMS - 2}").select("p_partkey")
        return n.select(term_id(F.col("p_partkey")).alias("whole"), F.explode(F.array(term_id(F.col("p_partkey") + 1), term_id(F.col("p_partkey") + 2))).alias("part"))

    @cached_property
    def pathway_combos(self) -> DataFrame:
        """(pathway, term, combo, need): a pathway is complete if all terms of one of its combos are present."""
        n = self.table("part").where(f"p_partkey < {TERMS - 4} AND p_partkey % 3 = 1").select(F.col("p_partkey").alias("n"))
        own = n.select(F.concat(F.lit("PWY-"), "n").alias("pathway"), term_id(F.col("n")).alias("term"), "n")
        first = own.select("pathway", "term", F.lit(0).alias("combo"), F.explode(F.array(term_id(F.col("n") + 1), term_id(F.col("n") + 2))).alias("need"))
        second = own.where("n % 2 = 0").select("pathway", "term", F.lit(1).alias("combo"), F.explode(F.array(term_id(F.col("n") + 3), term_id(F.col("n") + 4))).alias("need"))
        return first.unionByName(second)

    @cached_property
    def cds(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select((o * 100).alias("start"), (o * 100 + 50 + F.col("o_custkey") % 200).alias("end"), (o % 2 == 0).alias("complement"), F.concat(F.lit("E"), o.cast("string")).alias("entry"), F.concat(F.lit("c"), (o % 3).cast("string")).alias("component"))

    @cached_property
    def contigs(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("k"), c.cast("string")).alias("contig"), (c * 900).alias("start"), (c * 900 + F.when(c % 3 == 0, 1000).when(c % 3 == 1, 5000).otherwise(20000)).alias("end"), F.when(c % 3 == 0, 1000).when(c % 3 == 1, 5000).otherwise(20000).alias("length"))


#: The same tables for DuckDB.
CTE = {
    "predictions": "SELECT 'g' || s_nationkey AS genome, 'p' || l_partkey AS protein, 'GO:' || lpad((l_orderkey % 63)::VARCHAR, 7, '0') AS term, max(l_quantity) / 50.0 AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    "complex_scale": "SELECT 63 * greatest(1, count(*) // 2000) AS m FROM part",
    "complex_predictions": "SELECT 'g' || s_nationkey AS genome, 'p' || l_partkey AS protein, 'GO:' || lpad((l_orderkey % (SELECT m FROM complex_scale))::VARCHAR, 7, '0') AS term, max(l_quantity) / 50.0 AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    "complex_edges": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS child, 'GO:' || lpad(((p_partkey - 1) // 2)::VARCHAR, 7, '0') AS parent FROM part WHERE p_partkey BETWEEN 1 AND (SELECT m - 1 FROM complex_scale) UNION SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0'), 'GO:' || lpad(((p_partkey - 1) // 3)::VARCHAR, 7, '0') FROM part WHERE p_partkey BETWEEN 1 AND (SELECT m - 1 FROM complex_scale) AND p_partkey % 4 = 0",
    "complex_reach": "SELECT child AS node, parent AS ancestor FROM complex_edges UNION SELECT complex_reach.node, complex_edges.parent FROM complex_reach JOIN complex_edges ON complex_reach.ancestor = complex_edges.child",
    "complex_list": "SELECT node AS term FROM (SELECT node FROM complex_reach WHERE ancestor = 'GO:0000005' UNION SELECT 'GO:0000005') WHERE node NOT IN (SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') FROM part WHERE p_partkey % 9 = 0 AND p_partkey < (SELECT m FROM complex_scale))",
    "small_genomes": "SELECT DISTINCT 'g' || s_nationkey || '_' || (l_partkey // 20) AS genome, 'p' || l_partkey AS protein, 'GO:' || lpad((l_orderkey % 63)::VARCHAR, 7, '0') AS term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 3 = 0",
    "sequences": "SELECT 'p' || p_partkey AS protein, md5('f' || p_partkey // 4) || md5('g' || p_partkey // 4) || substr(md5('v' || p_partkey), 1, (p_partkey % 4 * 3)::INT) AS sequence FROM part",
    "annotations": "SELECT DISTINCT 'g' || s_nationkey AS genome, 'p' || l_partkey AS protein, 'GO:' || lpad((l_orderkey % 63)::VARCHAR, 7, '0') AS term FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 3 = 0",
    "terms": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'mf' WHEN 1 THEN 'bp' ELSE 'cc' END AS namespace, p_partkey % 20 = 19 AS is_obsolete FROM part WHERE p_partkey < 63",
    "go_edges": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS child, 'GO:' || lpad(((p_partkey - 1) // 2)::VARCHAR, 7, '0') AS parent, 'is_a' AS rel FROM part WHERE p_partkey BETWEEN 1 AND 62 UNION ALL SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0'), 'GO:' || lpad(((p_partkey - 1) // 3)::VARCHAR, 7, '0'), 'part_of' FROM part WHERE p_partkey BETWEEN 1 AND 62 AND p_partkey % 4 = 0",
    "edges": "SELECT DISTINCT child, parent FROM go_edges",
    "reach": "SELECT child AS node, parent AS ancestor FROM edges UNION SELECT reach.node, edges.parent FROM reach JOIN edges ON reach.ancestor = edges.child",
    "closed": "SELECT node, ancestor FROM reach UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges",
    "taxon_edges": "SELECT 'NCBITaxon_' || (n_nationkey + 100) AS child, 'NCBITaxon_' || (n_regionkey + 10) AS parent FROM nation UNION ALL SELECT 'NCBITaxon_' || (r_regionkey + 10), 'NCBITaxon_1' FROM region",
    "taxon_reach": "SELECT child AS node, parent AS ancestor FROM taxon_edges UNION SELECT taxon_reach.node, taxon_edges.parent FROM taxon_reach JOIN taxon_edges ON taxon_reach.ancestor = taxon_edges.child",
    "taxon_closed": "SELECT node, ancestor FROM taxon_reach UNION SELECT child, child FROM taxon_edges UNION SELECT parent, parent FROM taxon_edges",
    "disjoint": "SELECT 'NCBITaxon_' || (x.r_regionkey + 10) AS a, 'NCBITaxon_' || (y.r_regionkey + 10) AS b FROM region x JOIN region y ON x.r_regionkey < y.r_regionkey",
    "genomes": "SELECT 'g' || n_nationkey AS genome, 'NCBITaxon_' || (n_nationkey + 100) AS taxon FROM nation",
    "constraints": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS term, 'only_in_taxon' AS kind, 'NCBITaxon_' || (p_partkey % 5 + 10) AS taxon FROM part WHERE p_partkey < 63 AND p_partkey % 7 = 0 UNION ALL SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0'), 'never_in_taxon', 'NCBITaxon_' || (p_partkey % 25 + 100) FROM part WHERE p_partkey < 63 AND p_partkey % 11 = 3",
    "homodimers": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS term FROM part WHERE p_partkey % 9 = 0 AND p_partkey < 63",
    "complexes": "SELECT node AS term FROM closed WHERE ancestor = 'GO:0000005' AND node NOT IN (SELECT term FROM homodimers)",
    "has_part": "SELECT 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS whole, 'GO:' || lpad((p_partkey + d)::VARCHAR, 7, '0') AS part FROM part, (VALUES (1), (2)) v(d) WHERE p_partkey % 5 = 0 AND p_partkey < 61",
    "pathway_combos": "SELECT 'PWY-' || p_partkey AS pathway, 'GO:' || lpad(p_partkey::VARCHAR, 7, '0') AS term, c AS combo, 'GO:' || lpad((p_partkey + d)::VARCHAR, 7, '0') AS need FROM part, (VALUES (0, 1), (0, 2), (1, 3), (1, 4)) v(c, d) WHERE p_partkey < 59 AND p_partkey % 3 = 1 AND (c = 0 OR p_partkey % 2 = 0)",
    "cds": "SELECT o_orderkey * 100 AS start, o_orderkey * 100 + 50 + o_custkey % 200 AS \"end\", o_orderkey % 2 = 0 AS complement, 'E' || o_orderkey AS entry, 'c' || (o_orderkey % 3) AS component FROM orders",
    "contigs": "SELECT 'k' || c_custkey AS contig, c_custkey * 900 AS start, c_custkey * 900 + CASE c_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 5000 ELSE 20000 END AS \"end\", CASE c_custkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 5000 ELSE 20000 END AS length FROM customer",
}
NEEDS = {
    "edges": ["go_edges"], "reach": ["edges"], "closed": ["reach"], "taxon_reach": ["taxon_edges"], "taxon_closed": ["taxon_reach"], "complexes": ["closed", "homodimers"],
    "complex_predictions": ["complex_scale"], "complex_edges": ["complex_scale"], "complex_reach": ["complex_edges"], "complex_list": ["complex_reach"],
}


def with_tables(sql: str, *names: str) -> str:
    """SQL after the definitions of the tables it names, and of what those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {head}, {body[5:]}"
    return f"WITH RECURSIVE {head} {body}"
