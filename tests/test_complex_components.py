"""Stage 2 by components: closed form and search against enumeration, hard coupled components, limits of time."""

import itertools
import random
import tracemalloc

import pytest

from mendral.operators import repair_complex
from mendral.operators.components import components
from mendral.operators.pair_search import Component


def least(keys, has, cost, rules, groups):
    best = None
    for values in itertools.product((False, True), repeat=len(keys)):
        v = dict(zip(keys, values, strict=True))
        if any(v[a] and not v[b] for a, b in rules) or any(sum(v[x] for x in g) == 1 for g in groups):
            continue
        spent = sum(cost[k] for k in keys if v[k] != has[k])
        best = spent if best is None else min(best, spent)
    return best


@pytest.mark.parametrize("k", [2, 3])
def test_genomes_equal_enumeration(spark, k):
    """Genomes of three proteins and five terms, scores that are not propagated."""
    rng = random.Random(k)
    terms, edges, predictions = [f"t{i}" for i in range(5)], [], []
    edges = [(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i] + [("t4", "t1")]
    for g in range(80):
        predictions += [(f"g{g}", p, t, rng.choice([0.1, 0.2, 0.4, 0.6, 0.7, 0.9])) for p in ("p", "q", "r") for t in terms if rng.random() < 0.6]
    f = spark.createDataFrame
    scored, links, complexes = f(predictions, "genome string, protein string, term string, score double"), f(edges, "child string, parent string"), f([("t1",), ("t3",), ("t4",)], "term string")
    solved = repair_complex.solve_complexes(scored, 0.5, links, complexes, top_k=k).collect()
    part = {}
    for r in repair_complex.participants(scored, 0.5, complexes, k).collect():
        part.setdefault((r.genome, r.complex), []).append((r.protein, r.complex))
    genomes = {}
    for r in solved:
        genomes.setdefault(r.genome, []).append(r)
    assert len(genomes) > 30 and {g for g, _ in part} == set(genomes)
    for g, rows in genomes.items():
        keys = [(r.protein, r.term) for r in rows]
        has, cost, now = ({k: getattr(r, c) for k, r in zip(keys, rows, strict=True)} for c in ("annotated", "scaled", "present"))
        rules = [((p, a), (p, b)) for p, a in keys for c, b in edges if c == a and (p, b) in has]
        groups = [v for (h, _), v in part.items() if h == g]
        spent = sum(cost[k] for k in keys if now[k] != has[k])
        assert not any(now[a] and not now[b] for a, b in rules) and not any(sum(now[x] for x in m) == 1 for m in groups)
        if len(keys) <= 13:
            assert spent == least(keys, has, cost, rules, groups)
        assert {r.status for r in rows} == {"OPTIMAL"} and spent == sum({r.component: r.value for r in rows}.values())
        assert all(r.bound == r.value for r in rows)


def coupled(rng, m, k, high):
    """m complexes with k candidates each, all of which need the same term of their protein."""
    has, cost, rules, groups = [q == 0 for q in range(k)], [rng.randint(1, high) for _ in range(k)], [], []
    for _ in range(m):
        group = []
        for q in range(k):
            has.append(q == 0)
            cost.append(rng.randint(1, 900_000))
            group.append(len(has) - 1)
            rules.append((len(has) - 1, q))
        groups.append(group)
    return has, cost, rules, groups


def test_thirty_coupled_complexes_with_fifty_candidates():
    found = Component(*coupled(random.Random(7), 30, 50, 900_000)).solve()
    assert found.status == "OPTIMAL" and found.value == found.bound


def test_small_components_equal_enumeration():
    rng = random.Random(1)
    for _ in range(300):
        has, cost, rules, groups = coupled(rng, 2, 4, 9)
        cost = [c % 10 for c in cost]
        has = [h or rng.random() < 0.2 for h in has]
        keys = list(range(len(has)))
        found = Component(has, cost, rules, groups).solve()
        v = found.present
        assert found.value == least(keys, has, cost, rules, groups) == sum(c for c, h, x in zip(cost, has, v, strict=True) if h != x)
        assert not any(v[a] and not v[b] for a, b in rules) and not any(sum(v[x] for x in g) == 1 for g in groups)


def test_a_limit_of_time_leaves_a_value_and_a_bound():
    model = Component(*coupled(random.Random(3), 40, 50, 900_000))
    found = model.solve(seconds=0.3)
    assert found.status == "FEASIBLE" and 0 < found.bound < found.value
    assert sum(c for c, h, x in zip(model.cost, coupled(random.Random(3), 40, 50, 900_000)[0], found.present, strict=True) if h != x) == found.value


def test_components_of_numbers(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}


def test_full_model_equals_enumeration(spark):
    """All terms and proteins of tiny genomes, complexes that become lonely by a repair included."""
    rng = random.Random(11)
    terms, edges = ["t0", "t1", "t2", "t3"], [("t1", "t0"), ("t2", "t1"), ("t3", "t1")]
    rows = [(f"g{g}", p, t, rng.choice([0.1, 0.2, 0.4, 0.6, 0.7, 0.9])) for g in range(40) for p in ("p", "q", "r") for t in terms if rng.random() < 0.6]
    f = spark.createDataFrame
    solved = repair_complex.solve_full(f(rows, "genome string, protein string, term string, score double"), 0.5, f(edges, "child string, parent string"), f([("t1",), ("t2",), ("t3",)], "term string")).collect()
    now = {(r.genome, r.protein, r.term): r.present for r in solved}
    for g in {r[0] for r in rows}:
        score = {(p, t): s for h, p, t, s in rows if h == g}
        keys = [(p, t) for p in sorted({p for p, _ in score}) for t in terms]
        has = {k: score.get(k, 0) > 0.5 for k in keys}
        cost = {k: int(round(abs(score[k] - 0.5) if k in score else 0.5, 9) * 1_000_000) for k in keys}
        rules = [((p, a), (p, b)) for p, t in keys for a, b in edges if a == t]
        groups = [[(p, c) for p in {p for p, _ in keys}] for c in ("t1", "t2", "t3")]
        v = {k: now.get((g, *k), has[k]) for k in keys}
        assert not any(v[a] and not v[b] for a, b in rules) and not any(sum(v[x] for x in m) == 1 for m in groups)
        assert sum(cost[k] for k in keys if v[k] != has[k]) == least(keys, has, cost, rules, groups)


def test_full_model_without_violations(spark):
    f = spark.createDataFrame
    rows = f([("g", "p", "t", 0.9), ("g", "q", "t", 0.9)], "genome string, protein string, term string, score double")
    assert repair_complex.solve_full(rows, 0.5, f([], "child string, parent string"), f([("t",)], "term string")).count() == 0


def test_counts_equal_the_listed_pairs(spark):
    """What is counted within proteins against the pairs and links listed, on a hierarchy with a cycle and several ways up."""
    rng = random.Random(11)
    terms = [f"t{i:02d}" for i in range(14)]
    edges = [(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i for _ in range(2)] + [("t03", "t09"), ("t09", "t03")]
    have = [(f"g{g}", f"p{p}", t) for g in range(4) for p in range(9) for t in [*terms, "unknown"] if rng.random() < 0.3]
    part = [(f"g{g}", t, f"p{p}") for g in range(4) for p in range(11) for t in terms[1::2] if rng.random() < 0.25]
    f = spark.createDataFrame
    links, held, asked = f(edges, "child string, parent string").distinct(), f(have, "genome string, protein string, term string"), f(part, "genome string, complex string, protein string").distinct()
    pairs = {(r.genome, r.protein, r.term) for r in repair_complex.sparse_pairs(held.selectExpr("*", "1.0D AS score"), 0.5, links, asked).collect()}
    inside = [g for g, p, t in pairs for a, b in set(edges) if a == t and (g, p, b) in pairs]
    want = {g: (sum(x[0] == g for x in pairs), inside.count(g)) for g in {x[0] for x in pairs}}
    got = repair_complex.count_listed(held, asked, links, f([(t,) for t in terms], "term string"))
    assert {r.genome: (r.pairs, r.links) for r in got.collect()} == want


def test_pairs_of_all_proteins_equal_the_joined_ones(spark, monkeypatch):
    monkeypatch.setattr(repair_complex, "BLOCK", 2)
    rng = random.Random(12)
    terms = [f"t{i:02d}" for i in range(14)]
    edges = spark.createDataFrame([(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i for _ in range(2)], "child string, parent string").distinct()
    rows = [(f"g{g}", f"p{p}", t, rng.random()) for g in range(4) for p in range(6) for t in [*terms, "unknown"] if rng.random() < 0.5]
    scored, complexes = spark.createDataFrame(rows, "genome string, protein string, term string, score double"), spark.createDataFrame([(t,) for t in terms[2::2]], "term string")
    want = repair_complex.sparse_pairs(scored, 0.7, edges, repair_complex.participants(scored, 0.7, complexes)).collect()
    got = repair_complex.pairs_of_all_proteins(scored, 0.7, edges, complexes).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 50


def test_search_holds_no_set_as_long_as_its_component():
    # 2000 candidates of two complexes, each with ten pairs of its own above it; one candidate is cheap for both
    has, cost, rules, groups = [], [], [], [[], []]
    for p in range(2000):
        first = len(has)
        has += [p < 2] + [False] * 10
        cost += [50, *[900] * 10] if p != 7 else [1, *[2] * 10]
        rules += [(first + i, first + i + 1) for i in range(10)]
        groups[p % 2].append(first)
        if p == 7:
            groups[0].append(first)
    has[1:11] = has[12:22] = [True] * 10
    tracemalloc.start()
    found = Component(has, cost, rules, groups).solve()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found.value, found.bound, found.status) == (21, 21, "OPTIMAL")
    assert [i for i, p in enumerate(found.present) if p and not has[i]] == list(range(77, 88))
    assert peak < 30 << 20  # sets of as many bits as there are pairs took 60 MB and more


def test_search_without_kept_shares_is_still_exact(monkeypatch):
    rng = random.Random(11)
    for _ in range(5):
        parts = coupled(rng, 6, 5, 900_000)
        whole = Component(*parts).solve()
        with monkeypatch.context() as m:
            m.setattr("mendral.operators.pair_search.KEPT", 0)
            assert Component(*parts).solve().value == whole.value


def test_full_model_solves_again_only_what_is_violated(spark, monkeypatch):
    # g1: X lacks D; D is promoted, and is a complex on one protein then; g2: D goes at once
    rows = [("g1", "q", "X", 1.0), ("g1", "q", "D", 0.88), ("g1", "r", "Y", 1.0), ("g2", "q", "D", 0.92), ("g2", "r", "Y", 1.0)]
    p = spark.createDataFrame(rows, "genome string, protein string, term string, score double")
    edges = spark.createDataFrame([("X", "D")], "child string, parent string")
    complexes = spark.createDataFrame([("D",)], "term string")
    seen, tables = [], repair_complex.tables
    monkeypatch.setattr(repair_complex, "tables", lambda rows, *a: (seen.append({r[0] for r in a[2].select("genome").union(a[3].select("genome")).collect()}), tables(rows, *a))[1])
    out = repair_complex.solve_full(p, 0.9, edges, complexes).where("present <> annotated")
    assert sorted((r.genome, r.protein, r.term, r.present) for r in out.collect()) == [("g1", "q", "X", False), ("g2", "q", "D", False)]
    assert seen == [{"g1", "g2"}, {"g1"}]


def test_pairs_of_complexes_keep_the_columns_of_their_candidates(spark):
    p = spark.createDataFrame([("g", "p", "C", 1.0), ("g", "p", "A", 1.0)], "genome string, protein string, term string, score double")
    part = spark.createDataFrame([("g", "C", "p", 7), ("g", "C", "q", 7)], "genome string, complex string, protein string, hub long")
    edges = spark.createDataFrame([("A", "C"), ("C", "R")], "child string, parent string")
    out = repair_complex.pairs_of_complexes(p, 0.9, edges, part)
    assert sorted(tuple(r) for r in out.select("protein", "term", "hub").collect()) == [("p", "A", 7), ("p", "C", 7), ("q", "C", 7), ("q", "R", 7)]
