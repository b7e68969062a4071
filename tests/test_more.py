"""Report formats, closures from seeds, blocks of resamples, bounds of the complex search."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendral.functions import scalars as fn
from mendral.operators import hierarchy, repair_complex, stats
from mendral.plans import storage
from mendral.sources import tables


def test_consistent_genomes_of_both_report_formats(spark, tmp_path):
    log = tmp_path / "eval.out"
    log.write_text("start\n9 Yes\nPer-Taxon GAEF Metrics\n------\nTaxon  Consistent  IC\n------\n9606   Yes   0.5\n10090  No    0.1\n\n7   Yes\nAggregate GAEF Metrics Summary\n8 Yes\n")
    table = tmp_path / "per_taxon.tsv"
    table.write_text("name\tSatisfiable\tTaxon\nx\tTrue\t9606\ny\tFalse\t10090\nz\ttrue\t7\nshort\n")
    none = tmp_path / "none.out"
    none.write_text("Per-Taxon GAEF Metrics\n1 No\nAggregate GAEF Metrics Summary\n")
    taxa = lambda p: sorted(r["taxon"] for r in tables.read_consistent(spark, str(p)).collect())
    assert taxa(log) == ["7", "9606"] and taxa(table) == ["7", "9606"] and taxa(none) == []


def test_every_organism_has_its_number(spark):
    d = spark.createDataFrame([(n,) for n in ("Human", "Mouse", "Rat", "Pig", "Bovine", "Hamster", "Dog", "Rabbit", "Chicken", "Yeti")], "o string")
    got = [r[0] for r in d.select(fn.organism_number(F.col("o"))).collect()]
    assert got == ["9606", "10090", "10116", "9823", "9913", "10029", "9615", "9986", "9031", None]


def test_closure_from_a_seed_equals_the_full_one(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(60)] + [("a", "b"), ("b", "a")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    seed = spark.createDataFrame([("n1",), ("n2",), ("a",), ("alone",)], "term string")
    full = {(r["node"], r["ancestor"]) for r in hierarchy.closure(edges, reflexive=False).collect()}
    want = {"n1", "n2", "a", "alone"} | {b for a, b in full if a in ("n1", "n2", "a")}
    assert {r["term"] for r in hierarchy.closure_of(seed, edges).collect()} == want


def test_resamples_in_blocks_are_the_same_draws(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(size=700)
    pairs = spark.createDataFrame([("m", f"g{i:04d}", 0.0, float(x)) for i, x in enumerate(d)], "metric string, genome string, before double, after double")
    got = stats.bootstrap_mean(pairs, resamples=4000, seed=3).first()
    means = d[np.random.default_rng(3).integers(0, len(d), (4000, len(d)))].mean(axis=1)
    assert np.allclose((got["low"], got["high"]), np.percentile(means, [2.5, 97.5]), rtol=0, atol=1e-12)


def brute(has, cost, rules, groups):
    best = None
    for values in itertools.product((False, True), repeat=len(has)):
        v = dict(zip(sorted(has), values, strict=True))
        if any(v[a] and not v[b] for a, b in rules) or any(sum(v[x] for x in g) == 1 for g in groups):
            continue
        spent = sum(cost[x] for x in has if v[x] != has[x])
        best = spent if best is None else min(best, spent)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_bounded_search_equals_enumeration(seed):
    rng = random.Random(seed)
    for _ in range(25):
        terms, proteins = "abcd"[: rng.randint(2, 4)], [f"p{i}" for i in range(rng.randint(2, 3))]
        pairs = [(t, p) for t in terms for p in proteins]
        has = {x: rng.random() < 0.4 for x in pairs}
        cost = {x: rng.randint(0, 9) for x in pairs}
        rules = [((t, p), (u, p)) for i, t in enumerate(terms) for u in terms[:i] if rng.random() < 0.5 for p in proteins]
        groups = [[(t, p) for p in proteins] for t in terms if rng.random() < 0.7]
        decision, spent, status = repair_complex.solve_component(has, cost, rules, groups)
        assert status == "OPTIMAL" and spent == brute(has, cost, rules, groups)
        assert spent == sum(cost[x] for x in has if decision[x] != has[x])


def test_a_search_that_ends_early_leaves_pairs_as_they_are():
    pairs = [(t, f"p{i}") for t in "abcdef" for i in range(5)]
    has = {x: x[1] == "p0" for x in pairs}
    groups = [[x for x in pairs if x[0] == t] for t in "abcdef"]
    decision, _, status = repair_complex.solve_component(has, {x: 5 for x in pairs}, [((a, f"p{i}"), (b, f"p{i}")) for a, b in zip("bcdef", "abcde", strict=True) for i in range(5)], groups, nodes=2)
    assert status == "LIMIT" and decision == has


def test_a_cluster_must_name_its_shared_folder(spark):
    class Far:
        def __init__(self, master):
            self.conf, self.sparkContext = self, self
            self.master = master

        def get(self, *_):
            return None

        def getConf(self):
            return self

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_root(Far("spark://host:7077"))
    assert storage.scratch_root(spark).startswith("/")
