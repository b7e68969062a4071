"""The bootstrap made apart against numpy's generator in one piece."""

import numpy as np
import pytest

from mendral.operators import stats


@pytest.mark.parametrize("n", [2, 3, 25, 1000, 3_000_000_000])
def test_draws_are_those_of_one_generator(n):
    want = np.random.default_rng(7).integers(0, n, 5000)
    apart = np.concatenate([stats.draws(7, k * 700, 700, n) for k in range(12)])
    assert len(apart) >= 5000 and (apart[:5000] == want).all()


def test_interval_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(m, f"g{i:04d}", float(rng.random()), float(rng.random())) for m, n in (("a", 37), ("b", 200), ("one", 1)) for i in range(n)]
    got = {r.metric: (r.low, r.high) for r in stats.bootstrap_mean(spark.createDataFrame(rows, "metric string, genome string, before double, after double"), resamples=300, seed=5, segment=1000).collect()}
    for m in ("a", "b"):
        d = np.array([y - x for k, _, x, y in rows if k == m])
        means = d[np.random.default_rng(5).integers(0, len(d), (300, len(d)))].mean(axis=1)
        assert np.allclose(got[m], np.percentile(means, [2.5, 97.5]), atol=1e-12)
    d = rows[-1][3] - rows[-1][2]
    assert np.allclose(got["one"], (d, d))
    assert stats.bootstrap_mean(spark.createDataFrame([], "metric string, genome string, before double, after double")).count() == 0
