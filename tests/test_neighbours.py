"""Neighbours by cells against brute force."""

import numpy as np
import pytest

from mendral.operators import transfer


def brute(queries, base, k):
    unit = lambda v: np.asarray(v, np.float32).astype(float) / max(np.linalg.norm(np.asarray(v, np.float32).astype(float)), 1e-12)
    out = []
    for i, q in queries:
        rows = sorted((-round(float(unit(q) @ unit(v)), 9), j) for j, v in base if j != i)[:k]
        out += [(i, j, r + 1, round(-c, 6) + 0.0) for r, (c, j) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        x = np.concatenate([c + 0.05 * rng.standard_normal((40, 16)) for c in rng.standard_normal((10, 16))])
    else:
        x = rng.standard_normal((300, 16))
    x = np.concatenate([x, np.zeros((2, 16)), x[:3]])
    base = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    f = lambda rows: spark.createDataFrame(rows, "id long, vector array<float>")
    queries = base[::9] + base[-5:]
    got = sorted((r["query"], r["neighbour"], r["rank"], round(r["cosine"], 6) + 0.0) for r in transfer.nearest_by_cosine(f(queries), f(base), 4).collect())
    assert got == brute(queries, base, 4)


def test_fewer_vectors_than_asked(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    assert sorted((r["query"], r["neighbour"]) for r in transfer.nearest_by_cosine(rows, rows, 5).collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("part", [7, 50])
def test_bins_and_blocks_equal_brute_force(spark, monkeypatch, part):
    """Cells that share a bin, cells of several bins, copies with tied cosines, queries in blocks."""
    for name, value in (("PART", part), ("BLOCK", 9), ("CHUNK", 4)):
        monkeypatch.setattr(transfer, name, value)
    x = np.random.default_rng(5).standard_normal((90, 4))
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0), np.zeros((9, 4)), x[10:20]])
    base = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    f = lambda rows: spark.createDataFrame(rows, "id long, vector array<float>")
    queries = base[::3]
    got = sorted((r["query"], r["neighbour"], r["rank"], round(r["cosine"], 6) + 0.0) for r in transfer.nearest_by_cosine(f(queries), f(base), 6).collect())
    assert got == brute(queries, base, 6)
