"""Stage 1 as relations against the enumeration of all sets of taxa, on many small genomes at once."""

import itertools
import random

from pyspark.sql import functions as F

from mendral.operators import repair_taxon
from mendral.operators.repair_taxon import UNION, TaxonModel


def brute(m: TaxonModel, unions):
    """Least cost over all assignments of a genome's taxa, None if none is feasible."""
    best = None
    for bits in itertools.product((False, True), repeat=len(m.taxa)):
        v = dict(zip(m.taxa, bits, strict=True))
        if any(not v[x] for x in m.fixed) or any(v[x] and not v[y] for x in m.taxa for y in m.up[x]) or any(v[x] and v[y] for x in m.taxa for y in m.apart[x]):
            continue
        if any(x.startswith(UNION) and m.down[x] and v[x] != any(v[c] for c in m.down[x]) for x in m.taxa):
            continue
        cost = m.cost(m.bad(v))
        best = cost if best is None else min(best, cost)
    return best


def worlds(rng, shape):
    """(isa, disjoint, unions) of one taxonomy: a tree with unions, or anything."""
    names = [f"T{i}" for i in range(rng.randint(3, 6))]
    isa = {x: {names[rng.randrange(i)]} for i, x in enumerate(names) if i and (shape == "tree" or rng.random() < 0.7)}
    for u in range(rng.randint(0, 2)):
        u = f"{UNION}{u}"
        for c in rng.sample(names, 2):
            isa.setdefault(c, set()).add(u)
        if rng.random() < 0.7:
            isa[u] = {names[0]}
        names.append(u)
    disjoint = {}
    for _ in range(rng.randint(0, 2)):
        a, b = rng.sample(names, 2)
        disjoint.setdefault(a, set()).add(b)
    unions = {f"{UNION}0": set(rng.sample(names, 2))} if f"{UNION}0" in names and rng.random() < 0.3 else {}
    return names, isa, disjoint, unions


def solve_all(spark, rng, shape, genomes=60):
    names, isa, disjoint, unions = worlds(rng, shape)
    costs, rules, edges, given, models = [], [], [], [], {}
    for g in range(genomes):
        terms = [f"g{g}G{i}" for i in range(5)]
        up = {t: {rng.choice(terms[:i])} for i, t in enumerate(terms) if i and rng.random() < 0.6}
        pick = lambda: {t: set(rng.sample(names, rng.randint(1, 2))) for t in terms if rng.random() < 0.5}  # noqa: B023, E731
        only, never, taxon = pick(), pick(), rng.choice([None, None, *names])
        cost = {t: rng.randint(1, 9) for t in terms}
        models[f"g{g}"] = TaxonModel(cost, up, only, never, isa, disjoint, unions, taxon)
        costs += [(f"g{g}", t, c) for t, c in cost.items()]
        rules += [(t, k, x) for kind, k in ((only, "only_in_taxon"), (never, "never_in_taxon")) for t, xs in kind.items() for x in xs]
        edges += [(t, p) for t, ps in up.items() for p in ps]
        given += [(f"g{g}", taxon)] if taxon else []
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    flat = lambda d: [(k, x) for k, xs in d.items() for x in xs]
    solved = repair_taxon.solve_taxa(
        frame(costs, "genome string, term string, scaled long"), frame(edges, "child string, parent string"), frame(rules, "term string, kind string, taxon string"),
        frame(flat(isa), "child string, parent string"), frame(flat(disjoint), "a string, b string"), frame(flat(unions), "union string, member string"), frame(given, "genome string, taxon string"),
    )
    out = {}
    for r in solved.collect():
        out.setdefault(r.genome, []).append(r)
    return models, unions, out


def hold(models, unions, out):
    for g, m in models.items():
        want, rows = brute(m, unions), out[g]
        assert sorted(r.term for r in rows) == m.terms
        assert {r.status for r in rows} == {"INFEASIBLE" if want is None else "OPTIMAL"}
        assert {r.cost for r in rows} == {want or 0}
        gone = {r.term for r in rows if r.demoted}
        if want is None:
            assert not gone and not rows[0].taxa
            continue
        v = {x: x in set(rows[0].taxa) for x in m.taxa}
        assert m.cost(m.bad(v)) == want  # the taxa that are given go with this cost
        assert gone == {t for i, t in enumerate(m.terms) if m.bad(v) >> i & 1}
        assert all(v[y] for x in m.taxa if v[x] for y in m.up[x]) and not any(v[x] and v[y] for x in m.taxa for y in m.apart[x])


def test_trees(spark):
    for seed in range(4):
        hold(*solve_all(spark, random.Random(seed), "tree"))


def test_any_taxonomy(spark):
    for seed in range(10, 13):
        hold(*solve_all(spark, random.Random(seed), "any"))


def test_trees_need_no_search(spark, monkeypatch):
    """One root, unions with members, partners in the tree: all by joins."""
    called = []
    monkeypatch.setattr(repair_taxon, "_search", lambda *a: called.append(1))
    isa = [("bac", "root"), ("euk", "root"), ("e1", "euk"), ("e2", "euk"), ("bac", UNION + "1"), ("e1", UNION + "1"), (UNION + "1", "root")]
    f = spark.createDataFrame
    out = repair_taxon.solve_taxa(
        f([("g", "a", 5), ("g", "b", 2), ("g", "c", 1), ("h", "a", 1), ("h", "d", 1)], "genome string, term string, scaled long"), f([("b", "a")], "child string, parent string"),
        f([("a", "only_in_taxon", "e1"), ("b", "never_in_taxon", "euk"), ("c", "only_in_taxon", UNION + "1"), ("d", "only_in_taxon", "e2")], "term string, kind string, taxon string"),
        f(isa, "child string, parent string"), f([("bac", "euk")], "a string, b string"), None, f([("h", "bac")], "genome string, taxon string"),
    )
    rows = {(r.genome, r.term): (r.demoted, r.taxa, r.cost) for r in out.collect()}
    assert rows[("g", "b")] == (True, ["NCBITaxon_Union_1", "e1", "euk", "root"], 2)
    assert not rows[("g", "a")][0] and not rows[("g", "c")][0]
    assert rows[("h", "a")] == (True, ["NCBITaxon_Union_1", "bac", "root"], 2) and rows[("h", "d")][0]
    assert not called


def test_many_isolated_taxa_are_searched_without_a_limit(spark):
    f = spark.createDataFrame
    n = 14
    rules = [(f"t{i}", "only_in_taxon", f"x{i}") for i in range(n)] + [(f"u{i}", "never_in_taxon", f"x{i}") for i in range(n)]
    costs = [("g", f"t{i}", 3) for i in range(n)] + [("g", f"u{i}", 1 + i % 4) for i in range(n)]
    out = repair_taxon.solve_taxa(f(costs, "genome string, term string, scaled long"), f([], "child string, parent string"), f(rules, "term string, kind string, taxon string"), f([], "child string, parent string"), f([], "a string, b string"))
    assert out.agg(F.max("cost")).first()[0] == sum(min(3, 1 + i % 4) for i in range(n))
