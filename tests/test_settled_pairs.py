"""Decisions without a search against searches, and every annotated protein as a candidate against the whole model."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from mendral.operators import repair_complex
from mendral.operators.batches import whole
from mendral.operators.pair_search import Component, absent, settle
from mendral.plans import queries


def arrays(pairs, has, cost, rules, active):
    term = np.unique([t for t, _ in pairs], return_inverse=True)[1]
    a, b = (np.array([r[i] for r in rules], dtype=np.int64) for i in (0, 1))
    return term, np.array(has, bool), np.array(cost, np.int64), np.array([t in active for t, _ in pairs]), a, b


def test_settled_pairs_cost_what_a_search_finds():
    rng = random.Random(5)
    for _ in range(600):
        kinds, proteins = rng.randint(2, 6), rng.randint(2, 4)
        edges = {(t, rng.randrange(t)) for t in range(1, kinds) for _ in range(rng.randint(1, 2))} | ({(0, kinds - 1)} if rng.random() < 0.15 else set())
        active = [t for t in range(kinds) if rng.random() < 0.6]
        pairs = [(t, p) for t in range(kinds) for p in range(proteins) if rng.random() < 0.75] or [(0, 0)]
        high = rng.choice([3, 10, 1000])
        has = [rng.random() < 0.4 for _ in pairs]
        cost = [rng.randint(0, high) for _ in pairs]
        at = {x: i for i, x in enumerate(pairs)}
        rules = sorted((at[a, p], at[b, p]) for a, b in edges for p in range(proteins) if (a, p) in at and (b, p) in at)
        groups = [g for t in active if (g := [at[t, p] for p in range(proteins) if (t, p) in at])]
        model = arrays(pairs, has, cost, rules, active)
        found = settle(*model)
        v = found.present
        assert not any(v[a] and not v[b] for a, b in rules) and not any(sum(v[x] for x in g) == 1 for g in groups)
        assert sum(c for c, h, x in zip(cost, has, v, strict=True) if h != x) == Component(has, cost, rules, groups).solve().value
        assert not found.gap.any()


def test_candidates_that_cost_more_than_they_are_worth_are_never_listed_for_a_search():
    # 60 complexes of 200 candidates that share what is above them; one candidate of the first is cheap
    pairs, has, cost, rules = [], [], [], []
    for p in range(200):
        top = len(pairs)
        pairs += [(60 + i, p) for i in range(10)] + [(c, p) for c in range(60)]
        has += [p == 0] * 10 + [p == 0] * 60
        cost += [2 if p == 7 else 900] * 10 + [100 if p == 0 else 50 if (c, p) == (0, 7) else 900 for c in range(60)]
        rules += [(top + i + 1, top + i) for i in range(9)] + [(top + 10 + c, top + 9) for c in range(60)]
    model = arrays(pairs, has, cost, rules, range(60))
    tracemalloc.start()
    found = settle(*model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(model[2][found.present != model[1]].sum()) == 59 * 100 + 70
    assert len(pairs) - int(absent(*model).sum()) < 2500 and peak < 12 << 20  # a search of all of it took 25 MB


def test_tables_end_where_a_key_does():
    keys = [1] * 3 + [2] * 7 + [3] + [4] * 2
    for size in (1, 2, 3, 5, 13):
        for rows in (1, 4, 100):
            cut = [pa.record_batch({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
            got = [t["k"].to_pylist() for t in whole(iter(cut), "k", rows)]
            assert sum(got, []) == keys and not any(a[-1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_every_annotated_protein_is_a_candidate(spark):
    """Against the model that lists them all."""
    rng, tau = random.Random(2), 0.5
    terms = [f"t{i}" for i in range(9)]
    edges = sorted({(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i for _ in range(rng.choice([1, 1, 2]))})
    rows = []
    for g in range(90):
        low, dense = rng.choice([0.62, 0.9, 1.0]), rng.choice([0.15, 0.3, 0.5])
        rows += [(f"g{g}", f"p{p}", t, rng.choice([0.05, 0.3, 0.45, 0.5, 0.52, 0.58, low, low])) for p in range(rng.randint(2, 9)) for t in terms if rng.random() < dense]
    f = spark.createDataFrame
    scored, links, complexes = f(rows, "genome string, protein string, term string, score double"), f(edges, "child string, parent string"), f([(t,) for t in terms[1:7]], "term string")
    now = {(r.genome, r.protein, r.term): r.present for r in repair_complex.solve_complexes(scored, tau, links, complexes, top_k=None).collect()}
    every = repair_complex.participants(scored, tau, complexes)
    part, genomes = {}, {}
    for r in every.collect():
        part.setdefault((r.genome, r.complex), []).append((r.protein, r.complex))
    for r in repair_complex.pair_costs(scored, repair_complex.sparse_pairs(scored, tau, links, every), tau).collect():
        genomes.setdefault(r.genome, []).append(r)
    assert len(genomes) > 50 and set(now) < {(r.genome, r.protein, r.term) for rs in genomes.values() for r in rs}
    promoted = 0
    for g, rs in genomes.items():
        keys = [(r.protein, r.term) for r in rs]
        at = {k: i for i, k in enumerate(keys)}
        has, cost = [r.annotated for r in rs], [r.scaled for r in rs]
        rules = [(at[p, a], at[p, b]) for p, t in keys for a, b in edges if a == t and (p, b) in at]
        groups = [[at[x] for x in v] for (h, _), v in part.items() if h == g]
        v = [now.get((g, *k), h) for k, h in zip(keys, has, strict=True)]
        assert not any(v[a] and not v[b] for a, b in rules) and not any(sum(v[x] for x in m) == 1 for m in groups)
        assert sum(c for c, h, x in zip(cost, has, v, strict=True) if h != x) == Component(has, cost, rules, groups).solve().value
        promoted += sum(x and not h for h, x in zip(has, v, strict=True))
    assert promoted


def test_the_cheapest_partner_may_have_a_low_score(spark):
    # p alone has the complex and twelve terms below it; of six others the one with the least score has all that is above
    c, top, root = "GO:0000011", "GO:0000005", "GO:0000002"
    below = [f"GO:00000{n}" for n in range(23, 35)]
    rows = [("g", "p", t, 1.0) for t in (c, top, root, *below)] + [("g", "q", t, 1.0) for t in (top, root)] + [("g", "q", c, 0.8)]
    rows += [("g", f"r{i}", c, 0.89) for i in range(5)] + [("g", f"r{i}", "GO:0000001", 1.0) for i in range(5)]
    edges = [(c, top), (top, root)] + [(t, c) for t in below]
    f = spark.createDataFrame
    v = SimpleNamespace(complex_predictions=f(rows, "genome string, protein string, term string, score double"), complex_edges=f(edges, "child string, parent string"), complex_homodimers=f([(t,) for t in below], "term string"))
    v.keep = lambda *names: v
    changed = queries.complex_repair(v).where("present <> annotated").collect()
    assert [(r.protein, r.term, r.present, r.value, r.status) for r in changed] == [("q", c, True, 100_000, "OPTIMAL")]


def test_pairs_of_all_proteins_are_listed_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    seen, store = [], repair_complex.materialize
    monkeypatch.setattr(repair_complex, "TASK_PAIRS", 10)
    monkeypatch.setattr(repair_complex, "materialize", lambda df, label="table": (label == "proteins" and seen.append(df.rdd.getNumPartitions()), store(df, label))[1])
    rows = [("g", f"p{i:02d}", "R", 1.0) for i in range(40)] + [("g", "p00", "A", 1.0), ("g", "p01", "B", 1.0)]
    f = spark.createDataFrame
    scored, edges, complexes = f(rows, "genome string, protein string, term string, score double"), f([("A", "R"), ("B", "R")], "child string, parent string"), f([("A",), ("B",)], "term string")
    got = repair_complex.pairs_of_all_proteins(scored, 0.5, edges, complexes).collect()
    assert sorted((r.protein, r.term) for r in got) == [(f"p{i:02d}", t) for i in range(40) for t in "AB"]
    assert seen == [13]  # 40 proteins, 3 usual terms


def test_closed_forms_of_many_components_at_once():
    """A complex on one protein, its other members and chains above and below, against a search; ties go down, then to the first member."""
    rng = random.Random(9)
    term, has, cost, member, a, b, want, kinds = [], [], [], [], [], [], [], 0
    for _ in range(300):
        first, up, down, others = len(term), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 4)
        # members of the complex, then what is above each (the lone one has it), then what the lone one has below
        rows = [(0, m == 0, rng.randint(1, 4), True) for m in range(others + 1)]
        rules = []
        for m in range(others + 1):
            last = m
            for k in range(up):
                if m and rng.random() < 0.3:  # a member may have it
                    continue
                rows.append((1 + k, m == 0, rng.randint(1, 3), False))
                rules.append((last, len(rows) - 1))
                last = len(rows) - 1
        for k in range(down):
            rows.append((9 + k, True, rng.randint(1, 4), False))
            rules.append((len(rows) - 1, len(rows) - 2 if k else 0))
        groups = [list(range(others + 1))]
        want.append(Component([r[1] for r in rows], [r[2] for r in rows], rules, groups).solve().value)
        names = {t: kinds + i for i, t in enumerate(sorted({r[0] for r in rows}))}
        kinds += len(names)
        for t, h, c, m in rows:
            term.append(names[t]), has.append(h), cost.append(c), member.append(m)
        a += [first + x for x, _ in rules]
        b += [first + y for _, y in rules]
    term, has, cost, member, a, b = np.array(term), np.array(has), np.array(cost), np.array(member), np.array(a), np.array(b)
    found = repair_complex.closed_form(term, has, cost, member, a, b)
    assert int(cost[found.present != has].sum()) == sum(want)
    v = found.present
    on = np.bincount(term[member], v[member], kinds)
    assert not (on == 1).any() and not (v[a] & ~v[b]).any()
    # a tie: to go costs 3, as does either partner; then both partners cost 2
    for high, joined in ((3, []), (2, [1])):
        tie = repair_complex.closed_form(np.zeros(3, int), np.array([True, False, False]), np.array([3, high, high]), np.array([True] * 3), np.empty(0, int), np.empty(0, int))
        assert list(np.flatnonzero(tie.present)) == ([0, *joined] if joined else [])
