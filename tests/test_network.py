"""Training on the rows of a table against training on arrays."""

import numpy as np

from mendral.operators.transfer import MultiLabelNet


def test_rows_give_the_weights_that_arrays_give(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((90, 6)), rng.random((90, 4)) < 0.3
    terms = list("abcd")
    rows = [([float(v) for v in a], [int(i) for i in np.flatnonzero(b)] if b.any() else None) for a, b in zip(x, y, strict=True)]
    table = spark.createDataFrame(rows, "vector array<double>, positions array<int>").repartition(5)
    one = MultiLabelNet(6, 8, terms).fit(x, y.astype(float), epochs=4, batch=len(x))
    two = MultiLabelNet(6, 8, terms).fit_rows(table, epochs=4, block=50)
    for k in one.p:
        assert np.allclose(one.p[k], two.p[k], atol=1e-7), k
    start = MultiLabelNet(6, 8, terms).p
    assert all((MultiLabelNet(6, 8, terms).fit_rows(table.limit(0)).p[k] == start[k]).all() for k in start)


def test_derivatives_are_numeric_ones():
    rng = np.random.default_rng(4)
    net = MultiLabelNet(5, 7, list("ab"))
    x, y = rng.standard_normal((20, 5)), (rng.random((20, 2)) < 0.5).astype(float)

    def loss():
        q = net.forward(x)[2]
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).sum() / len(x)

    g = net.gradients(x, y, len(x))
    for k, v in net.p.items():
        for at in [np.unravel_index(i, v.shape) for i in rng.choice(v.size, min(10, v.size), replace=False)]:
            keep, ends = v[at], []
            for step in (1e-6, -1e-6):
                v[at] = keep + step
                ends.append(loss())
            v[at] = keep
            assert abs((ends[0] - ends[1]) / 2e-6 - g[k][at]) < 1e-5
