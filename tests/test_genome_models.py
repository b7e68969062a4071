"""The full model of many genomes in a task: against enumeration, and against the one that deals a genome's pairs."""

import random

import numpy as np
import pytest

from mendral.operators import genome_models, repair_complex
from mendral.operators.hierarchy import closure, propagate_scores
from mendral.operators.pair_search import Component
from mendral.operators.repair_complex import Upward
from mendral.plans import queries
from mendral.plans.adapters import Views


@pytest.mark.parametrize("lifted", [True, False])
def test_genomes_cost_what_a_search_of_the_whole_model_finds(lifted):
    """Genomes of up to five proteins and six terms; scores that are not lifted leave pairs without a parent."""
    rng, tau, n = random.Random(4), 0.5, 6
    edges = sorted({(t, rng.randrange(t)) for t in range(1, n) for _ in range(2)})
    up, listed = Upward(n, *(np.array(x) for x in zip(*edges, strict=True))), np.array([False, True, True, False, True, True])
    first, to = up.above
    scores, genome = {}, []
    for g in range(150):
        for _ in range(rng.randint(2, 5)):
            row = len(genome)
            genome.append(g)
            scores |= {(row, t): rng.choice([0.05, 0.3, 0.45, 0.52, 0.62, 0.9]) for t in range(n) if rng.random() < 0.4}
            if lifted:
                for t in sorted((t for r, t in list(scores) if r == row), reverse=True):
                    for x in to[first[t] : first[t + 1]]:
                        scores[row, int(x)] = max(scores.get((row, int(x)), 0), scores[row, t])
    keys = sorted(scores)
    model = genome_models.Genomes(np.array([r * n + t for r, t in keys]), np.array([scores[k] for k in keys]), np.array(genome), up, listed, tau)
    pairs, present = model.solve()
    flips = dict(zip(map(int, pairs), map(bool, present), strict=True))
    promoted = 0
    for g in range(150):
        every = [(r, t) for r, h in enumerate(genome) if h == g for t in range(n)]
        at = {k: i for i, k in enumerate(every)}
        has = [scores.get(k, 0) > tau for k in every]
        cost = [int(c) for c in genome_models.margins(np.array([scores.get(k, 0.0) for k in every]), tau)]
        rules = [(at[r, a], at[r, b]) for r, t in every for a, b in edges if a == t]
        groups = [[i for i, (_, t) in enumerate(every) if t == c] for c in np.flatnonzero(listed)]
        v = [flips.get(r * n + t, h) for (r, t), h in zip(every, has, strict=True)]
        assert not any(v[a] and not v[b] for a, b in rules) and not any(sum(v[x] for x in m) == 1 for m in groups)
        assert sum(c for c, h, x in zip(cost, has, v, strict=True) if h != x) == Component(has, cost, rules, groups).solve().value
        promoted += sum(x and not h for h, x in zip(has, v, strict=True))
    assert promoted > 10 and len(pairs) > 100


def test_genomes_of_a_task_equal_those_dealt_over_tasks(spark):
    rng, terms = random.Random(8), [f"t{i}" for i in range(8)]
    edges = sorted({(t, terms[rng.randrange(i)]) for i, t in enumerate(terms) if i for _ in range(2)})
    rows = [(f"g{g}", f"p{p}", t, rng.choice([0.1, 0.4, 0.48, 0.55, 0.9])) for g in range(60) for p in range(5) for t in [*terms, "unknown"] for _ in range(rng.choice([0, 0, 0, 1, 2]))]
    f = spark.createDataFrame
    lines, links, complexes = f(rows, "genome string, protein string, term string, score double"), f(edges, "child string, parent string"), f([(t,) for t in terms[2:]], "term string")
    cost = lambda changed: {r.genome: r.cost for r in changed.groupBy("genome").agg({"scaled": "sum"}).withColumnRenamed("sum(scaled)", "cost").collect()}
    scored = propagate_scores(lines.groupBy("genome", "protein", "term").agg({"score": "max"}).withColumnRenamed("max(score)", "score"), closure(links))
    want = cost(repair_complex.solve_full(scored, 0.5, links, complexes).where("present <> annotated"))
    got = genome_models.solve_genomes(lines, 0.5, links, complexes, 3)
    assert len(want) > 20 and cost(got) == want and {r.status for r in got.collect()} == {"OPTIMAL"}


def test_the_full_model_deals_its_lines_once(spark, sf):
    changed = queries.full_model(Views(spark, sf))
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and changed.count() > 0
