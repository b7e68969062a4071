"""Stage 1 repair: the cheapest set of terms to demote so that a genome fits some taxa.

Costs per (genome, term) are aggregated by Spark. Once the set of true taxa is
known, the terms that must go are known too: those with an only-in taxon that is
false or a never-in taxon that is true, and everything below them within the
genome's own terms. Sibling taxa exclude each other, so under one root the true
taxa are a chain from the root to some taxon, with the unions it passes. The
candidates of a genome are therefore its taxa, and all of it is relational:

1. Constraints go down the hierarchy, a level a round, within each genome's terms.
2. A genome's taxa are those its terms name, what is above them, and partners
   that are disjoint from these.
3. Each taxon's chain is its closure; chains that hold disjoint taxa, members of
   one union that exclude each other, or miss a given taxon are no candidates.
4. Terms with the same constraints are one signature with a summed cost. A
   signature is kept by the candidates that hold all its only-in taxa and no
   never-in taxon: a count of matches for each (signature, candidate) that meet.
5. The cheapest candidate wins; ties go to fewer taxa, then to the lesser name.

Taxa that nothing speaks against (a union without present members, say, that only
only-in constraints name) are true whenever what is above them is; taxa that
nothing speaks for are false. Genomes whose taxa are no single tree (several
roots, a second parent, a union that may go either way) are solved each by an exact
depth-first search over their own rows, without a limit of states; its ties go to the
assignment found first. Without a feasible assignment nothing changes.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendral.plans.storage import materialize, materialize_counted

from .annotate import demote, flip_costs
from .hierarchy import closure, closure_of, small, with_self

UNION = "NCBITaxon_Union_"


def reach(edges: dict[str, set[str]], seeds: set[str]) -> set[str]:
    """Seeds and all that is reached from them."""
    seen, todo = set(seeds), list(seeds)
    while todo:
        for y in edges.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


class TaxonModel:
    """Taxa that matter to one genome and the rules between them."""

    def __init__(self, costs: dict[str, int], edges: dict[str, set[str]], only: dict[str, set[str]], never: dict[str, set[str]], isa: dict[str, set[str]], disjoint: dict[str, set[str]], unions: dict[str, set[str]], taxon: str | list[str] | None):
        self.terms = sorted(costs)
        self.costs = [costs[t] for t in self.terms]
        index = {t: i for i, t in enumerate(self.terms)}
        children: dict[str, set[str]] = defaultdict(set)
        for t in self.terms:
            for up in edges.get(t, ()):
                if up in index:
                    children[up].add(t)
        self.below = {t: sum(1 << index[x] for x in reach(children, {t})) for t in self.terms}
        named = {x for t in self.terms for x in only.get(t, set()) | never.get(t, set())}
        self.fixed = [taxon] if isinstance(taxon, str) else list(taxon or ())
        taxa = reach(isa, named | set(self.fixed))
        taxa = reach(disjoint, taxa)  # partners come without what is above them
        self.taxa, self.taxon = sorted(taxa), taxon
        self.if_false: dict[str, int] = defaultdict(int)
        self.if_true: dict[str, int] = defaultdict(int)
        for t in self.terms:
            for x in only.get(t, ()):
                self.if_false[x] |= self.below[t]
            for x in never.get(t, ()):
                self.if_true[x] |= self.below[t]
        self.up = {x: isa.get(x, set()) & taxa for x in taxa}
        self.down: dict[str, set[str]] = defaultdict(set)
        for x, above in self.up.items():
            for a in above:
                self.down[a].add(x)
        self.apart: dict[str, set[str]] = defaultdict(set)

        def exclude(group: set[str]) -> None:
            for a in group:
                self.apart[a] |= group - {a}

        for x in taxa:
            for y in disjoint.get(x, set()) & taxa:
                self.apart[x].add(y)
                self.apart[y].add(x)
            if x.startswith(UNION):
                exclude(unions.get(x, set()) & taxa)
            else:
                exclude({y for y in self.down[x] if not y.startswith(UNION)})

    def propagate(self, known: dict[str, bool], todo: list[tuple[str, bool]]) -> bool:
        while todo:
            x, v = todo.pop()
            if x in known:
                if known[x] != v:
                    return False
                continue
            known[x] = v
            if v:
                todo += [(y, True) for y in self.up[x]] + [(y, False) for y in self.apart[x]]
            else:
                todo += [(y, False) for y in self.down[x]]
            for u in {x, *self.up[x]}:
                if u.startswith(UNION) and self.down[u]:
                    if all(known.get(c) is False for c in self.down[u]):
                        todo.append((u, False))
                    elif known.get(u):
                        left = [c for c in self.down[u] if known.get(c) is not False]
                        if len(left) == 1:
                            todo.append((left[0], True))
        return True

    def bad(self, known: dict[str, bool]) -> int:
        mask = 0
        for x, v in known.items():
            mask |= self.if_true.get(x, 0) if v else self.if_false.get(x, 0)
        return mask

    def cost(self, mask: int) -> int:
        total = 0
        while mask:
            low = mask & -mask
            total += self.costs[low.bit_length() - 1]
            mask ^= low
        return total

    def solve(self) -> tuple[list[str], list[str], int, str]:
        """(terms to demote, true taxa, cost, status), depth first with the best assignment so far as a bound."""
        start: dict[str, bool] = {}
        if not self.propagate(start, [(x, True) for x in self.fixed]):
            return [], [], 0, "INFEASIBLE"
        order = sorted(self.taxa, key=lambda x: (-self.cost(self.if_false.get(x, 0) | self.if_true.get(x, 0)), x))
        best: tuple[int, dict[str, bool]] | None = None
        stack = [(self.cost(self.bad(start)), start)]
        while stack:
            cost, known = stack.pop()
            if best is not None and cost >= best[0]:
                continue
            free = next((x for x in order if x not in known), None)
            if free is None:
                best = (cost, known)
                continue
            children = []
            for v in (False, True):
                child = dict(known)
                if self.propagate(child, [(free, v)]):
                    children.append((self.cost(self.bad(child)), child))
            stack += sorted(children, key=lambda c: -c[0])  # the cheaper one is looked at first
        if best is None:
            return [], [], 0, "INFEASIBLE"
        mask = self.bad(best[1])
        return [t for i, t in enumerate(self.terms) if mask >> i & 1], sorted(x for x, v in best[1].items() if v), best[0], "OPTIMAL"


SOLVED = "genome string, term string, demoted boolean, taxa array<string>, cost long, status string"


def is_union(taxon: str) -> Column:
    return F.col(taxon).startswith(UNION)


def inherited(costs: DataFrame, edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """(genome, term, kind, taxon): constraints of a genome's terms and of those above them, through the genome's own terms only."""
    terms = costs.select("genome", "term").distinct()
    down = edges.select(F.col("parent").alias("term"), F.col("child").alias("below")).where("term IS NOT NULL AND below IS NOT NULL").distinct()
    front, n = materialize_counted(terms.join(constraints.select("term", "kind", "taxon"), "term").select("genome", "term", "kind", "taxon").distinct(), "inherited")
    seen = front
    while n:
        step = front.join(down, "term").select("genome", F.col("below").alias("term"), "kind", "taxon").distinct()
        fresh = step.join(terms, ["genome", "term"], "left_semi").join(seen, ["genome", "term", "kind", "taxon"], "left_anti")
        front, n = materialize_counted(fresh, "inherited")
        seen = seen.unionByName(front) if n else seen
    return seen


def genome_taxa(named: DataFrame, taxon_edges: DataFrame, disjoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genome, taxon, partner) of all taxa that matter to a genome, and (node, ancestor) of the taxa that any genome names.

    A partner comes by ``disjoint`` only, without what is above it.
    """
    seeds = named.select("taxon").distinct()
    known = closure_of(seeds, taxon_edges)
    lineage = materialize(with_self(closure(taxon_edges.join(known.select(F.col("taxon").alias("child")), "child", "left_semi"), reflexive=False), known), "lineages")
    own = named.join(lineage, F.col("taxon") == F.col("node")).select("genome", F.col("ancestor").alias("taxon")).distinct()
    away = closure(disjoint.select(F.col("a").alias("child"), F.col("b").alias("parent")), reflexive=False)
    met = own.join(away, F.col("taxon") == F.col("node")).select("genome", F.col("ancestor").alias("taxon"), F.lit(True).alias("partner"))
    both = own.withColumn("partner", F.lit(False)).unionByName(met).groupBy("genome", "taxon").agg(F.min("partner").alias("partner"))
    return materialize(both, "genome-taxa"), lineage


def classified(taxa: DataFrame, links: DataFrame, apart: DataFrame, rules: DataFrame, given: DataFrame | None) -> DataFrame:
    """(genome, taxon, role, parent): what each taxon can be.

    ``tree`` and ``root`` are in the chains, ``union`` follows its members, ``true``
    holds whenever ``parent`` (if any) does, ``false`` never does, ``open`` is any other.
    """
    plain = ~is_union("parent")
    up = links.groupBy("genome", F.col("child").alias("taxon")).agg(F.count_if(plain).alias("above"), F.count("*").alias("parents"), F.min(F.when(plain, F.col("parent"))).alias("parent"))
    down = links.groupBy("genome", F.col("parent").alias("taxon")).agg(F.count("*").alias("below"))
    touched = apart.select("genome", F.explode(F.array("a", "b")).alias("taxon")).distinct().withColumn("touched", F.lit(True))
    wanted = rules.groupBy("genome", "taxon").agg(F.bool_or(F.col("kind") == "only_in_taxon").alias("only"), F.bool_or(F.col("kind") == "never_in_taxon").alias("never"))
    rows = reduce(lambda a, b: a.join(b, ["genome", "taxon"], "left"), [up, down, touched, wanted], taxa)
    rows = rows.join(given.select("genome", "taxon", F.lit(True).alias("given")).distinct(), ["genome", "taxon"], "left") if given is not None else rows.withColumn("given", F.lit(False))
    rows = rows.na.fill(0, ["above", "parents", "below"]).na.fill(False, ["touched", "only", "never", "given"])
    union, leaf, alone = is_union("taxon"), F.col("below") == 0, F.col("parents") == 0
    held = F.col("given") | F.col("only")
    role = (
        F.when(F.col("partner") & leaf & alone, "false")
        .when(leaf & ~held & (union | alone), "false")
        .when(leaf & ~F.col("touched") & ~F.col("never") & (alone | (union & (F.col("parents") == 1) & (F.col("above") == 1))), "true")
        .when(union, F.when(leaf, "open").otherwise("union"))
        .when(F.col("partner") & (F.col("parents") != 1), "open")
        .when(F.col("above") == 1, "tree")
        .when((F.col("above") == 0) & alone, "root")
        .otherwise("open")
    )
    return materialize(rows.select("genome", "taxon", role.alias("role"), F.when(role == "true", F.col("parent")).alias("parent"), "partner"), "taxon-roles")


def solve_taxa(costs: DataFrame, edges: DataFrame, constraints: DataFrame, taxon_edges: DataFrame, disjoint: DataFrame, unions: DataFrame | None = None, genomes: DataFrame | None = None) -> DataFrame:
    """One row per (genome, term): demoted or not, with the genome's taxa, cost and status.

    ``costs`` is (genome, term, scaled); ``disjoint`` (a, b) reads "a disjoint from b";
    ``unions`` (union, member) says whose members exclude each other; ``genomes``
    (genome, taxon) fixes taxa, genomes without one are inferred.
    """
    costs = materialize(costs.select("genome", "term", "scaled"), "costs")
    rules = inherited(costs, edges, constraints)
    present = materialize(costs.select("genome").distinct(), "genomes")
    given = None if genomes is None else genomes.select("genome", "taxon").where("taxon IS NOT NULL").join(present, "genome", "left_semi").distinct()
    named = rules.select("genome", "taxon") if given is None else rules.select("genome", "taxon").unionByName(given)
    taxa, lineage = genome_taxa(named.distinct(), taxon_edges, disjoint)

    mine = lambda c: taxa.select("genome", F.col("taxon").alias(c))
    within = lambda pairs, a, b: materialize(mine(a).join(pairs, a).join(mine(b), ["genome", b]).select("genome", a, b), "taxon-pairs")
    links = within(taxon_edges.select("child", "parent").distinct(), "child", "parent")
    pairs = disjoint.select("a", "b")
    if unions is not None:  # members exclude each other where their union matters
        m = unions.select("union", "member").distinct()
        joint = m.join(m.select("union", F.col("member").alias("other")), "union").where("member < other").select("union", F.col("member").alias("a"), F.col("other").alias("b"))
        at = mine("union").join(joint, "union").join(mine("a"), ["genome", "a"]).join(mine("b"), ["genome", "b"]).select("genome", "a", "b")
        apart = materialize(within(pairs.distinct(), "a", "b").unionByName(at), "taxa-apart")
    else:
        apart = within(pairs.distinct(), "a", "b")
    roles = classified(taxa, links, apart, rules, given)
    lone_parent = links.join(taxa.where("partner").select("genome", F.col("taxon").alias("parent")), ["genome", "parent"], "left_semi").select("genome").distinct()
    odd = roles.groupBy("genome").agg(F.count_if(F.col("role") == "open").alias("open"), F.count_if(F.col("role") == "root").alias("roots")).where("open > 0 OR roots > 1").select("genome")
    odd = materialize(odd.unionByName(lone_parent).distinct(), "genomes-no-tree")
    roles = roles.join(odd, "genome", "left_anti")
    rules_ = rules.join(odd, "genome", "left_anti")

    # chains: what is true with each candidate x
    nodes = roles.where("role IN ('tree', 'root')").select("genome", F.col("taxon").alias("x"), "partner")
    upward = nodes.where("NOT partner").select("genome", "x").join(lineage.select(F.col("node").alias("x"), F.col("ancestor").alias("taxon")), "x").select("genome", "x", "taxon")
    late = nodes.where("partner").select("genome", "x").join(links.select("genome", F.col("child").alias("x"), F.col("parent").alias("node")), ["genome", "x"]).join(lineage, "node").select("genome", "x", F.col("ancestor").alias("taxon"))
    chains = materialize(upward.unionByName(late).unionByName(nodes.where("partner").select("genome", "x", F.col("x").alias("taxon"))).distinct(), "chains")
    both = apart.join(chains.withColumnRenamed("taxon", "a"), ["genome", "a"]).join(chains.withColumnRenamed("taxon", "b"), ["genome", "x", "b"], "left_semi").select("genome", "x")
    plain_links = links.where(~is_union("child") & ~is_union("parent"))
    forked = chains.select("genome", "x", F.col("taxon").alias("child")).join(plain_links, ["genome", "child"]).groupBy("genome", "x", "parent").agg(F.count("*").alias("n")).where("n > 1").select("genome", "x")
    candidates = nodes.select("genome", "x").join(both.unionByName(forked).distinct(), ["genome", "x"], "left_anti")
    simple = present.join(odd, "genome", "left_anti")
    empty = simple.select("genome", F.lit(None).cast("string").alias("x"))
    if given is not None:
        kept = given.join(roles.select("genome", "taxon", "role", "parent"), ["genome", "taxon"])
        must = kept.select("genome", F.when(F.col("role") == "true", F.col("parent")).otherwise(F.col("taxon")).alias("taxon")).where("taxon IS NOT NULL")
        asked = must.groupBy("genome").agg(F.count("*").alias("asked"))
        have = chains.join(must, ["genome", "taxon"]).groupBy("genome", "x").agg(F.count("*").alias("have"))
        candidates = candidates.join(asked, "genome", "left").join(have, ["genome", "x"], "left").where("coalesce(have, 0) = coalesce(asked, 0)").select("genome", "x")
        empty = empty.join(asked, "genome", "left_anti")
    candidates = candidates.unionByName(empty)

    # what each signature of constraints costs, and the candidates that keep it
    facts = rules_.join(roles.select("genome", "taxon", "role", "parent"), ["genome", "taxon"])
    stands = F.when(F.col("role") == "true", F.col("parent")).otherwise(F.col("taxon"))
    facts = facts.where(~((F.col("kind") == "never_in_taxon") & (F.col("role") == "false"))).select("genome", "term", (F.col("kind") == "only_in_taxon").alias("only"), stands.alias("taxon")).where("taxon IS NOT NULL")
    signed = facts.groupBy("genome", "term").agg(F.sort_array(F.collect_set(F.struct("only", "taxon"))).alias("signature"))  # as many as taxa constrain a term
    grouped = signed.join(costs, ["genome", "term"]).groupBy("genome", "signature").agg(F.sum("scaled").alias("c"))
    signatures = materialize(grouped.withColumn("s", F.monotonically_increasing_id()).withColumn("need", F.size(F.filter("signature", lambda r: r["only"]))), "signatures")
    met = signatures.select("genome", "s", "c", "need", F.explode("signature").alias("r")).select("genome", "s", "c", "need", "r.only", "r.taxon").join(chains, ["genome", "taxon"])
    met = met.groupBy("genome", "x", "s").agg(F.first("c").alias("c"), F.first("need").alias("need"), F.count_if("only").alias("got"), F.count_if(~F.col("only")).alias("hit"))
    change = F.when((F.col("need") > 0) & (F.col("got") == F.col("need")) & (F.col("hit") == 0), -F.col("c")).when((F.col("need") == 0) & (F.col("hit") > 0), F.col("c"))
    changes = met.groupBy("genome", "x").agg(F.sum(change).alias("change"))
    base = signatures.where("need > 0").groupBy("genome").agg(F.sum("c").alias("base"))
    length = chains.groupBy("genome", "x").agg(F.count("*").alias("length"))
    priced = candidates.join(changes, ["genome", "x"], "left").join(length, ["genome", "x"], "left").join(base, "genome", "left")
    order = F.struct((F.coalesce("base", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("cost"), F.coalesce("length", F.lit(0)).alias("length"), "x")
    best = materialize(priced.groupBy("genome").agg(F.min(order).alias("b")).select("genome", "b.x", "b.cost"), "best-taxa")

    # true taxa of the winner, and the terms that don't fit them
    line = best.join(chains, ["genome", "x"]).select("genome", "taxon")
    free = roles.where("role = 'true'").join(best.select("genome"), "genome", "left_semi")
    loose = free.where("parent IS NULL").select("genome", "taxon").unionByName(free.join(line.withColumnRenamed("taxon", "parent"), ["genome", "parent"], "left_semi").select("genome", "taxon"))
    true = line.unionByName(loose).distinct()
    fit = rules_.join(best.select("genome"), "genome", "left_semi").join(true.withColumn("holds", F.lit(True)), ["genome", "taxon"], "left")
    gone = fit.where((F.col("kind") == "only_in_taxon") == F.col("holds").isNull()).select("genome", "term", F.lit(True).alias("gone")).distinct()
    named_taxa = true.groupBy("genome").agg(F.sort_array(F.collect_list("taxon")).alias("taxa"))  # a chain and its unions
    answer = simple.join(best, "genome", "left").join(named_taxa, "genome", "left")
    none = F.array().cast("array<string>")
    out = costs.join(answer, "genome").join(gone, ["genome", "term"], "left").select("genome", "term", F.coalesce("gone", F.lit(False)).alias("demoted"), F.coalesce("taxa", none).alias("taxa"), F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.when(F.col("cost").isNull(), "INFEASIBLE").otherwise("OPTIMAL").alias("status"))
    if not odd.limit(1).count():
        return out
    return out.unionByName(_search(odd, costs, rules, constraints, edges, links, apart, given))


def _search(odd: DataFrame, costs: DataFrame, rules: DataFrame, constraints: DataFrame, edges: DataFrame, links: DataFrame, apart: DataFrame, given: DataFrame | None) -> DataFrame:
    """The genomes whose taxa are no single tree, each one's own rows in a task: at most its terms, taxa and the links between them."""
    own = lambda df: df.join(odd, "genome", "left_semi")
    terms = own(costs)
    up = terms.select("genome", F.col("term").alias("child")).join(small(edges.select("child", "parent").distinct()), "child").join(terms.select("genome", F.col("term").alias("parent")), ["genome", "parent"], "left_semi")
    # a constraint is inherited through the genome's own terms: the model needs the direct ones
    direct = own(rules).join(small(constraints.select("term", "kind", "taxon").distinct()), ["term", "kind", "taxon"], "left_semi")
    line = lambda df, kind, a, b, n=None: df.select("genome", (F.lit(kind) if isinstance(kind, str) else kind).alias("what"), F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("string")).alias("b"), (F.col(n) if n else F.lit(0)).cast("long").alias("n"))
    parts = [line(terms, "cost", "term", None, "scaled"), line(up, "edge", "child", "parent"), line(direct, F.col("kind"), "term", "taxon"), line(own(links), "isa", "child", "parent"), line(own(apart), "apart", "a", "b")]
    if given is not None:
        parts.append(line(own(given), "given", "taxon", None))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        table = {k: list(zip(g["a"], g["b"], g["n"], strict=True)) for k, g in pdf.groupby("what")}

        def sets(kind: str) -> dict[str, set[str]]:
            out: dict[str, set[str]] = defaultdict(set)
            for a, b, _ in table.get(kind, ()):
                out[a].add(b)
            return out

        fixed = sorted(a for a, _, _ in table.get("given", ()))
        model = TaxonModel({a: int(n) for a, _, n in table["cost"]}, sets("edge"), sets("only_in_taxon"), sets("never_in_taxon"), sets("isa"), sets("apart"), {}, fixed)
        bad, true, cost, status = model.solve()
        gone = set(bad)
        return pd.DataFrame({"genome": pdf["genome"].iloc[0], "term": model.terms, "demoted": [t in gone for t in model.terms], "taxa": [true] * len(model.terms), "cost": cost, "status": status})

    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("genome").applyInPandas(solve, SOLVED)


def repair(predictions: DataFrame, tau: float, edges: DataFrame, constraints: DataFrame, taxon_edges: DataFrame, disjoint: DataFrame, unions: DataFrame | None = None, genomes: DataFrame | None = None, mode: str = "margin", ic: DataFrame | None = None) -> DataFrame:
    """Predictions without the annotated rows of demoted terms."""
    solved = solve_taxa(flip_costs(predictions, tau, mode, ic), edges, constraints, taxon_edges, disjoint, unions, genomes)
    return demote(predictions, solved.where("demoted"), tau)
