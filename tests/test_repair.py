"""Both repair stages: goldens, brute force on random small instances, properties."""

import itertools
import random

import pytest

from mendral.operators import annotate, repair_complex, repair_taxon
from mendral.operators.repair_complex import solve_component, solve_genome
from mendral.operators.repair_taxon import UNION, TaxonModel

EDGES = [("GO:0009001", "GO:0008000"), ("GO:0008002", "GO:0008000"), ("GO:0008003", "GO:0008000"), ("GO:0099001", "GO:0032991")]


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for i in range(1, 51):
        p = f"p{i:02d}"
        rows += [(p, "GO:0008002", 0.50 + ((7 * i) % 5) * 0.08), (p, "GO:0008003", 0.45 + ((3 * i) % 4) * 0.10)]
        if i % 4 == 1:
            rows.append((p, "GO:0009001", 0.90))
        if i <= 3:
            rows.append((p, "GO:0099001", (0.85, 0.28, 0.12)[i - 1]))
    return spark.createDataFrame([("g", p, t, round(s, 6)) for p, t, s in rows], "genome string, protein string, term string, score double")


@pytest.fixture(scope="module")
def dims(spark):
    return {
        "edges": spark.createDataFrame(EDGES, "child string, parent string"),
        "constraints": spark.createDataFrame([("GO:0009001", "only_in_taxon", "NCBITaxon_2")], "term string, kind string, taxon string"),
        "taxon_edges": spark.createDataFrame([("NCBITaxon_2", "NCBITaxon_131567"), ("NCBITaxon_2759", "NCBITaxon_131567")], "child string, parent string"),
        "disjoint": spark.createDataFrame([("NCBITaxon_2759", "NCBITaxon_2")], "a string, b string"),
        "genomes": spark.createDataFrame([("g", "NCBITaxon_2759")], "genome string, taxon string"),
    }


def table(df):
    return {(r["protein"], r["term"]): round(r["score"], 6) for r in df.collect()}


def test_golden_organism(spark, golden, dims):
    one = repair_taxon.repair(golden, 0.3, **dims)
    before, after = table(golden), table(one)
    gone = set(before) - set(after)
    assert len(gone) == 13 and {t for _, t in gone} == {"GO:0009001"}
    complexes = spark.createDataFrame([("GO:0099001",)], "term string")
    two = table(repair_complex.repair(one, 0.3, dims["edges"], complexes, top_k=5))
    assert {k: (after[k], two.get(k)) for k in after if after[k] != two.get(k)} == {("p02", "GO:0099001"): (0.28, 0.301)}
    assert set(two) == set(after)


def test_stage_one_is_idempotent_and_keeps_low_rows(spark, golden, dims):
    low = golden.unionByName(spark.createDataFrame([("g", "p60", "GO:0009001", 0.2)], golden.schema))
    one = repair_taxon.repair(low, 0.3, **dims)
    assert table(one)[("p60", "GO:0009001")] == 0.2
    assert table(repair_taxon.repair(one, 0.3, **dims)) == table(one)


def test_and_semantics_of_the_solver(spark, golden, dims):
    """Two only-in taxa must both hold in the solver."""
    both = dims | {"constraints": spark.createDataFrame([("GO:0008002", "only_in_taxon", "NCBITaxon_2759"), ("GO:0008002", "only_in_taxon", "NCBITaxon_2")], "term string, kind string, taxon string")}
    assert "GO:0008002" not in {t for _, t in table(repair_taxon.repair(golden, 0.3, **both))}


def brute_taxa(m: TaxonModel) -> int | None:
    best = None
    for bits in itertools.product((False, True), repeat=len(m.taxa)):
        v = dict(zip(m.taxa, bits, strict=True))
        if m.taxon and not v[m.taxon]:
            continue
        if any(v[x] and not v[y] for x in m.taxa for y in m.up[x]) or any(v[x] and v[y] for x in m.taxa for y in m.apart[x]):
            continue
        if any(x.startswith(UNION) and m.down[x] and v[x] != any(v[c] for c in m.down[x]) for x in m.taxa):
            continue
        cost = m.cost(m.bad(v))
        best = cost if best is None else min(best, cost)
    return best


def test_taxon_search_is_optimal():
    rng = random.Random(3)
    for _ in range(400):
        names = [f"T{i}" for i in range(rng.randint(2, 5))] + [f"{UNION}{i}" for i in range(rng.randint(0, 2))]
        isa = {x: {rng.choice(names[:i])} for i, x in enumerate(names) if i and rng.random() < 0.8}
        for u in (x for x in names if x.startswith(UNION)):
            for c in rng.sample(names, 2):
                if c != u:
                    isa.setdefault(c, set()).add(u) if not isa.get(u, set()) & {c} else None
        disjoint = {a: {b} for a, b in [rng.sample(names, 2)]} if rng.random() < 0.5 else {}
        terms = [f"G{i}" for i in range(5)]
        edges = {t: {rng.choice(terms[:i])} for i, t in enumerate(terms) if i and rng.random() < 0.6}
        pick = lambda: {t: set(rng.sample(names, rng.randint(1, 2))) for t in terms if rng.random() < 0.5}
        m = TaxonModel({t: rng.randint(1, 9) for t in terms}, edges, pick(), pick(), isa, disjoint, {}, rng.choice([None, *names]))
        want = brute_taxa(m)
        bad, _, cost, status = m.solve()
        assert (status == "INFEASIBLE") == (want is None)
        if want is not None:
            assert cost == want and m.cost(sum(1 << m.terms.index(t) for t in bad)) == want


def brute_pairs(has, cost, rules, groups):
    best, keys = None, sorted(has)
    for bits in itertools.product((False, True), repeat=len(keys)):
        v = dict(zip(keys, bits, strict=True))
        if any(v[a] and not v[b] for a, b in rules) or any(sum(v[x] for x in g) == 1 for g in groups):
            continue
        spent = sum(cost[k] for k in keys if v[k] != has[k])
        best = spent if best is None else min(best, spent)
    return best


def test_complex_search_is_optimal_and_components_add_up():
    rng = random.Random(5)
    for _ in range(300):
        terms, proteins = ["A", "B", "C", "D"], ["p", "q", "r"]
        edges = {t: {rng.choice(terms[:i])} for i, t in enumerate(terms) if i and rng.random() < 0.7}
        pairs = sorted((t, p) for t in terms for p in proteins if rng.random() < 0.7)
        has = {x: rng.random() < 0.5 for x in pairs}
        cost = {x: rng.randint(0, 5) for x in pairs}
        groups = {c: [p for t, p in pairs if t == c] for c in rng.sample(terms, rng.randint(1, 2))}
        sets_ = [[(c, p) for p in ps] for c, ps in groups.items() if ps]
        rules = [((t, p), (u, p)) for t, p in pairs for u in edges.get(t, ()) if (u, p) in has]
        want = brute_pairs(has, cost, rules, sets_)
        got, spent, status = solve_component(has, cost, rules, sets_)
        assert status == "OPTIMAL" and spent == want
        whole = solve_genome(pairs, has, cost, edges, groups)
        assert sum(cost[x] for x, v, _, _ in whole if v != has[x]) == want


def test_no_active_complex_leaves_all(spark):
    rows = spark.createDataFrame([("g", "p", "X", 0.9), ("g", "q", "X", 0.8)], "genome string, protein string, term string, score double")
    edges = spark.createDataFrame([("X", "R")], "child string, parent string")
    out = repair_complex.repair(rows, 0.5, edges, spark.createDataFrame([("X",)], "term string"), top_k=2)
    assert table(out) == table(rows)


def test_cost_modes(spark, golden):
    with pytest.raises(ValueError):
        annotate.flip_costs(golden, 0.3, "other")
    with pytest.raises(ValueError):
        annotate.flip_costs(golden, 0.3, "ic")
    c = {r["term"]: r["scaled"] for r in annotate.flip_costs(golden, 0.3).collect()}
    assert c["GO:0009001"] == 7_800_000
