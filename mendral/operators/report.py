"""The full report of each genome: completeness, coherence, consistency and information, with what is missing.

Facts are read once: every annotation goes to the ancestors of its term with flags, which
fold to a row for each protein and term, then for each genome and term, then to one for each
genome that lists its terms. What a section asks of two terms of a genome is a fold of its
terms by what is asked (``coherence.met_items``), not a join of the terms with themselves.
Sections that a sub-ontology does not speak of have no columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from mendral.plans.storage import materialize_counted

from .coherence import met_items
from .consistency import unsatisfiable
from .hierarchy import small

#: Sub-ontologies whose report has a section; without a sub-ontology all sections are there.
SECTIONS = {"essential": ("bp",), "pathways": ("bp", "mf"), "complexes": ("cc",)}


@dataclass(frozen=True)
class Rules:
    """The dimensions that genomes are judged by.

    ``reach`` and ``isa_reach`` are closures (node, ancestor) over all relations and over is_a only,
    ``complex_root`` the term above all complexes; ``ec_map`` (ec, term) names what a pathway lacks
    by enzyme numbers, without it by terms.
    """

    terms: DataFrame
    reach: DataFrame
    isa_reach: DataFrame
    essential: DataFrame
    has_part: DataFrame
    combos: DataFrame
    complex_root: str
    homodimers: DataFrame
    constraints: DataFrame
    disjoint: DataFrame
    taxon_reach: DataFrame
    ec_map: DataFrame | None = None
    core: str = "Core"


#: What an annotation says of a term for its protein: the protein has it, it is annotated with it, has a term below it, has it over is_a as a complex; and that the protein is there at all.
HELD, OWN, ABOVE, COMPLEX, PROTEIN = 1, 2, 4, 8, 16
#: Terms of genomes that one task lists.
TASK_TERMS = 100_000


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) > 0


def complex_reach(isa_reach: DataFrame, root: str) -> DataFrame:
    """(node, ancestor) over is_a as far as the ancestor is the root of complexes or below it."""
    below = isa_reach.where(F.col("ancestor") == root).select("node").unionByName(isa_reach.sparkSession.createDataFrame([(root,)], "node string")).distinct()
    return isa_reach.select("node", "ancestor").join(below.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node", "ancestor").unionByName(below.select("node", F.col("node").alias("ancestor")))


def upward(rules: Rules, complexes: bool) -> DataFrame:
    """(node, ups): the terms that an annotation with ``node`` speaks of, each with its flags."""
    own = F.when(F.col("node") == F.col("ancestor"), HELD | OWN).otherwise(HELD | ABOVE)
    pairs = rules.reach.select("node", "ancestor", own.alias("flags"))
    if complexes:
        pairs = pairs.unionByName(complex_reach(rules.isa_reach, rules.complex_root).withColumn("flags", F.lit(COMPLEX)))
    pairs = pairs.unionByName(pairs.select("node", F.col("node").alias("ancestor"), F.lit(HELD | OWN).alias("flags")))
    one = pairs.groupBy("node", "ancestor").agg(F.bit_or("flags").alias("flags"))
    return one.groupBy("node").agg(F.collect_list(F.struct(F.col("ancestor").alias("term"), "flags")).alias("ups"))


def term_rows(annotations: DataFrame, ups: DataFrame) -> DataFrame:
    """(genome, term, n, k, c, proteins, flags): how many proteins have a term, have it as a specific one, and have it as a complex.

    Facts are read once. Proteins are counted in a row without a term. Rows that come dealt by genome are not moved.
    """
    kind = annotations.schema["term"].dataType
    unknown = F.array(F.struct(F.col("term"), F.lit(HELD | OWN).alias("flags")))
    mark = F.array(F.struct(F.lit(None).cast(kind).alias("term"), F.lit(PROTEIN).alias("flags")))
    rows = annotations.where("genome IS NOT NULL").select("genome", "protein", "term").join(small(ups), F.col("term") == F.col("node"), "left")
    each = rows.select("genome", "protein", F.inline(F.concat(F.coalesce("ups", unknown), mark)))
    per = each.groupBy("genome", "protein", "term").agg(F.bit_or("flags").alias("flags"))
    named = F.col("protein").isNotNull()
    return per.groupBy("genome", "term").agg(
        F.count_if(has(HELD)).alias("n"), F.count_if(has(OWN) & (~has(ABOVE) | ~named)).alias("k"), F.count_if(has(COMPLEX) & named).alias("c"), F.count_if(has(PROTEIN) & named).alias("proteins"), F.bit_or("flags").alias("flags")
    )


def genome_rows(terms: DataFrame, rules: Rules, subontology: str | None) -> DataFrame:
    """A row for each genome: the terms it is annotated with, those it has, and the sections that need no other term of it."""
    mark = lambda rows, term, known, category, homo: rows.select(F.col(term).alias("term"), known.alias("known"), category.alias("category"), homo.alias("homo"))
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
    marks = mark(rules.terms, "id", yes, none, no).unionByName(mark(rules.essential, "term", no, F.col("category"), no)).unionByName(mark(rules.homodimers, "term", no, none, yes))
    listed = small(marks.groupBy("term").agg(F.bool_or("known").alias("known"), F.collect_set("category").alias("categories"), F.bool_or("homo").alias("homo")))
    rows = terms.join(listed, "term", "left")
    known = has(HELD) & F.col("known")
    out = [F.collect_list(F.when(has(OWN), F.col("term"))).alias("own_terms"), F.collect_list(F.when(has(HELD), F.col("term"))).alias("held_terms")]
    sections = []
    if has_section("essential", subontology):
        sizes = {r["category"]: r["n"] for r in rules.essential.groupBy("category").agg(F.count_distinct("term").alias("n")).collect()}  # a row for each category
        number = {c: f"found{i}" for i, c in enumerate(sorted(sizes))}
        out += [F.count_if(has(HELD) & F.array_contains("categories", c)).alias(name) for c, name in number.items()]
        out.append(F.array_sort(F.collect_list(F.when(has(HELD) & (F.size("categories") > 0), F.col("term")))).alias("found_terms"))
        pct = 100.0 * F.col(number[rules.core]) / sizes[rules.core] if sizes.get(rules.core) else F.lit(0.0)
        kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.col(name).alias("found"), F.lit(sizes[c]).cast("long").alias("size")) for c, name in number.items()])
        sections.append(F.struct(pct.alias("percentage"), "found_terms", kinds.alias("categories")).alias("essential"))
    if has_section("complexes", subontology):
        good = F.coalesce("homo", no) | (F.col("c") > 1)
        out += [F.count_if(has(COMPLEX)).alias("complex"), F.count_if(has(COMPLEX) & good).alias("good"), F.array_sort(F.collect_list(F.when(has(COMPLEX), F.struct("term", F.when(good, "coherent").otherwise("incoherent").alias("kind"))))).alias("classes")]
        sections.append(F.struct(F.when(F.col("complex") > 0, 100.0 * F.col("good") / F.col("complex")).otherwise(0.0).alias("percentage"), "classes").alias("complexes"))
    out += [F.sum("proteins").alias("proteins"), F.sum("k").alias("k"), F.sum(F.when(known, F.col("n"))).alias("total"), F.min(F.when(known, F.col("n"))).alias("least"), F.array_sort(F.collect_list(F.when(known, F.struct("n", "k")))).alias("counts")]
    # a term's content is that among the genome's own annotations, over the greatest one
    content = lambda n: -F.log2(n / F.col("total"))
    share = lambda n: F.when(content(F.col("least")) > 0, content(n) / content(F.col("least"))).otherwise(0.0)
    breadth = F.aggregate("counts", F.lit(0.0), lambda sum_, x: sum_ + x["k"] * share(x["n"]))
    over = lambda c: F.when(F.col(c) > 0, F.col("breadth") / F.col(c)).otherwise(0.0)
    sections.append(F.struct(over("k").alias("depth"), "breadth", over("proteins").alias("breadth_per_protein")).alias("information"))
    return rows.groupBy("genome").agg(*out).withColumn("breadth", breadth).select("genome", "own_terms", "held_terms", *sections)


def process_section(own: DataFrame, has_part: DataFrame) -> DataFrame:
    """(genome, process): share of the parts of present wholes that are present, and for each whole the parts it lacks. Terms count as annotated, without ancestors."""
    asked = met_items(own, has_part.select("whole", "part"), "whole", "part").where("asked")
    lacks = ~F.col("met")
    whole = asked.groupBy("genome", "whole").agg(F.count("*").alias("n"), F.count_if(lacks).alias("m"), F.array_sort(F.collect_list(F.when(lacks, F.col("part")))).alias("missing_parts"))
    row = F.when(F.col("m") > 0, F.struct(F.col("whole").alias("annotated_term"), "missing_parts"))
    return whole.groupBy("genome").agg((100.0 - 100.0 * F.sum("m") / F.sum("n")).alias("percentage"), F.array_sort(F.collect_list(row)).alias("missing")).select("genome", F.struct("percentage", "missing").alias("process"))


def pathway_section(held: DataFrame, combos: DataFrame, ec_map: DataFrame | None = None) -> DataFrame:
    """(genome, pathways): counts of pathways whose own term is present, and for each whether it is complete and what its combos lack."""
    asked = met_items(held, combos.select("pathway", "term", "combo", "need"), "term", "need").where("asked")
    rows = asked.withColumn("lack", F.when(~F.col("met"), F.col("need")))
    component = F.col("lacks")
    if ec_map is not None:
        rows = rows.join(small(ec_map.groupBy(F.col("term").alias("lack")).agg(F.collect_set("ec").alias("ecs"))), "lack", "left")
        component = F.array_distinct(F.flatten("lacks"))
    combo = rows.groupBy("genome", "pathway", "term", "combo").agg(F.count("lack").alias("m"), F.collect_list("lack" if ec_map is None else "ecs").alias("lacks"))
    named = F.when((F.col("m") > 0) & (F.size("lacks") > 0), F.array_sort(component))
    whole = combo.groupBy("genome", "pathway", "term").agg(F.bool_or(F.col("m") == 0).alias("complete"), F.array_sort(F.collect_list(named)).alias("missing"))
    nothing = F.array().cast("array<array<string>>")
    detail = F.struct("pathway", F.col("term").alias("original_term"), "complete", F.when(F.col("complete"), nothing).otherwise(F.col("missing")).alias("missing_components"))
    done, all_ = F.col("completed"), F.col("annotated")
    per = whole.groupBy("genome").agg(F.count_if("complete").alias("completed"), F.count("*").alias("annotated"), F.array_sort(F.collect_list(detail)).alias("details"))
    return per.select("genome", F.struct((100.0 * done / all_).alias("percentage"), done, all_, (all_ - done).alias("incomplete"), "details").alias("pathways"))


def _filled(section: Column, kind: StructType) -> Column:
    """A section of a genome that it says nothing of: zeros and empty lists."""
    empty = F.struct(*[(F.array() if isinstance(f.dataType, ArrayType) else F.lit(0)).cast(f.dataType).alias(f.name) for f in kind.fields])
    return F.coalesce(section, empty)


def has_section(name: str, subontology: str | None) -> bool:
    return subontology is None or subontology in SECTIONS[name]


def full_report(annotations: DataFrame, rules: Rules, subontology: str | None = None) -> DataFrame:
    """One row for each genome with a nested column for each section that ``subontology`` (bp, cc, mf; None: all) has.

    Process coherence, consistency and information are always there. Genomes without
    annotations have no row; shares of nothing are 0.
    """
    if subontology not in (None, "bp", "cc", "mf"):
        raise ValueError(f"no sub-ontology: {subontology}")
    terms = term_rows(annotations, upward(rules, has_section("complexes", subontology)))
    stored, n = materialize_counted(genome_rows(terms, rules, subontology), "genome-rows", F.coalesce(F.sum(F.size("held_terms")), F.lit(0)))
    tasks = max(annotations.sparkSession.sparkContext.defaultParallelism, n // TASK_TERMS + 1)
    dealt = lambda c: stored.select("genome", c).repartition(tasks, "genome").select("genome", F.explode(c).alias("term"))
    out = stored.drop("own_terms", "held_terms").repartition(tasks, "genome")
    parts = {"process": process_section(dealt("own_terms"), rules.has_part)}
    if has_section("pathways", subontology):
        parts["pathways"] = pathway_section(dealt("held_terms"), rules.combos, rules.ec_map)
    for name, part in parts.items():
        out = out.join(part, "genome", "left").withColumn(name, _filled(F.col(name), part.schema[name].dataType))
    bad = unsatisfiable(dealt("held_terms"), rules.constraints, rules.disjoint, rules.taxon_reach).withColumn("bad", F.lit(True))
    out = out.join(bad, "genome", "left").withColumn("satisfiable", F.col("bad").isNull())
    order = ("process", "essential", "pathways", "complexes", "information", "satisfiable")
    return out.select("genome", *[c for c in order if c in out.columns])


def _rounded(c: Column, digits: int) -> Column:
    return c.withField("percentage", F.round(c["percentage"], digits))


def report_lines(report: DataFrame, digits: int = 2) -> DataFrame:
    """(genome, value): the report as JSON, percentages rounded, lists as sorted arrays."""
    shares = {c: _rounded(F.col(c), digits) for c in ("process", "essential", "pathways", "complexes") if c in report.columns}
    return report.withColumns(shares).select("genome", F.to_json(F.struct(*report.columns)).alias("value"))
