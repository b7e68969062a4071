"""Networks of balls and ensembles against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mendral.operators import ensembles, hierarchy
from mendral.operators.ensembles import BallNet
from mendral.operators.transfer import MultiLabelNet
from mendral.sources import scored

TERMS = list("abcd")
EDGES = [("a", "x"), ("b", "x"), ("x", "root"), ("c", "y"), ("y", "root"), ("a", "b"), ("zz", "y")]


def test_derivatives_of_balls_are_numeric_ones():
    rng = np.random.default_rng(5)
    net = BallNet(5, 7, TERMS)
    net.p["radius"][1] *= -1
    x, y = rng.standard_normal((20, 5)), (rng.random((20, 4)) < 0.5).astype(float)

    def loss():
        q = net.forward(x)[2]
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum() / len(x)

    g = net.gradients(x, y, len(x))
    assert set(g) == set(net.p)
    for k, v in net.p.items():
        for at in [np.unravel_index(i, v.shape) for i in rng.choice(v.size, min(10, v.size), replace=False)]:
            keep, ends = v[at], []
            for step in (1e-6, -1e-6):
                v[at] = keep + step
                ends.append(loss())
            v[at] = keep
            assert abs((ends[0] - ends[1]) / 2e-6 - g[k][at]) < 1e-5


def test_distances_to_balls(spark):
    rng = np.random.default_rng(6)
    net = BallNet(5, 7, TERMS)
    x = rng.standard_normal((9, 5))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    got = {(r["id"], r["term"]): r["score"] for r in net.distances(rows).collect()}
    for i, r in enumerate(net.mapped(x)[1]):
        for j, t in enumerate(TERMS):
            far = np.linalg.norm(r - (net.p["centre"][j] + net.p["relation"])) - abs(net.p["radius"][j]) - net.margin
            assert got[i, t] == pytest.approx(max(far, 0), abs=1e-9)


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    nets = [MultiLabelNet(5, 6, TERMS, 1), BallNet(5, 6, TERMS, 2), BallNet(5, 6, TERMS, 3)]
    x = [[float(v) for v in r] for r in rng.standard_normal((40, 5))]
    x[3], x[4] = x[3][:2], x[4] + [9.0, 9.0]
    rows = spark.createDataFrame([*enumerate(x), (99, None)], "id long, vector array<double>").repartition(3)
    reach = hierarchy.closure(spark.createDataFrame(EDGES, "child string, parent string"))
    above = {"a": "abxr", "b": "bxr", "c": "cyr", "d": "d"}
    names = {"r": "root"}
    want = {}
    for i, v in enumerate(x):
        v = np.array((v + [0.0] * 5)[:5])[None, :]
        s = np.mean([n.forward(v)[2][0] for n in nets], axis=0)
        for t, score in zip(TERMS, s, strict=True):
            for k in above[t]:
                key = (i, names.get(k, k))
                want[key] = max(want.get(key, 0), score)
    return nets, rows, reach, want


def pairs(df):
    return {(r["id"], r["term"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("most", [ensembles.REACH_PAIRS, 2])
def test_ensemble_with_ancestors(case, most):
    nets, rows, reach, want = case
    got = pairs(ensembles.predict(nets, rows, reach, most_pairs=most))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    high = pairs(ensembles.predict(nets, rows, reach, floor=0.5, most_pairs=most))
    assert high.keys() == {k for k, v in want.items() if v >= 0.5}


def test_blocks_do_not_change_scores(case, monkeypatch):
    nets, rows, _, _ = case
    up = ensembles.Upward(TERMS, pd.DataFrame({"node": ["a", "a", "b"], "ancestor": ["x", "b", "x"]}))
    s = np.random.default_rng(1).random((7, 4))
    whole = np.concatenate([b for _, b in up.blocks(s)])
    monkeypatch.setattr(ensembles, "HELD", 1)
    assert (np.concatenate([b for _, b in up.blocks(s)]) == whole).all()
    assert list(up.terms) == ["a", "b", "c", "d", "x"]
    assert (whole[:, 4] == s[:, :2].max(1)).all() and (whole[:, 0] == s[:, 0]).all()


def test_empty_tables_and_mixed_vocabularies(spark, case):
    nets, rows, reach, _ = case
    assert ensembles.predict(nets, rows.limit(0), reach).count() == 0
    alone = pairs(ensembles.predict(nets, rows, reach.limit(0)))
    assert {t for _, t in alone} == set(TERMS)
    with pytest.raises(ValueError, match="vocabulary"):
        ensembles.predict([nets[0], MultiLabelNet(5, 6, ["a"])], rows, reach)


def test_written_scores_name_proteins_without_any(spark, case, tmp_path):
    nets, rows, reach, want = case
    protein = F.col("id").cast("string").alias("protein")
    high = ensembles.predict(nets, rows, reach, floor=0.9).select(protein, "term", "score")
    lines = scored.scored_lines(high, rows.select(protein), 0.9)
    path = str(tmp_path / "scores")
    lines.write.text(path)
    back = scored.read_scored(spark, path, keep_empty=True)
    assert {r["protein"] for r in back.select("protein").distinct().collect()} == {str(i) for i in [*range(40), 99]}
    assert back.where("term IS NOT NULL").count() == sum(v >= 0.9 for v in want.values())
