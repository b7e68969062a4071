"""The training of the byte network against numeric derivatives of its loss."""

import numpy as np

from mendral.llm.language_id import FILTERS, WIDTHS, WINDOW, ByteConvNet


def loss(p, win, label, weight):
    """Weighted cross entropy in 64 bits: a plain convolution at every position, pooling, softmax."""
    e = p["E"][win]
    pooled = []
    for w in WIDTHS:
        at = WINDOW - w + 1
        out = sum(e[:, j : j + at] @ p[f"W{w}"][j] for j in range(w))
        pooled.append(np.maximum(out.max(axis=1) + p[f"b{w}"], 0))
    z = np.concatenate(pooled, axis=1) @ p["V"] + p["c"]
    z -= z.max(axis=1, keepdims=True)
    log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return float((-log[np.arange(len(label)), label] * weight[label]).mean())


def test_first_step_goes_against_the_numeric_derivative():
    """Adam's first step is the rate times the sign of each derivative, whatever its size."""
    rng = np.random.default_rng(3)
    net = ByteConvNet(["a", "b", "c"])
    win = rng.integers(97, 123, (18, WINDOW)).astype(np.uint8)
    label = np.array([0] * 9 + [1] * 6 + [2] * 3)
    weight = 1 / np.bincount(label)
    weight = weight / weight[label].mean()
    before = {k: v.copy() for k, v in net.p.items()}
    net.fit(win, label, epochs=1, batch=len(win), rate=1e-6)
    checked = 0
    for name, value in before.items():
        for at in rng.choice(value.size, min(30, value.size), replace=False):
            place = np.unravel_index(at, value.shape)
            if name == "E" and not 97 <= place[0] < 123:
                continue
            slope = []
            for step in (1e-5, -1e-5):
                p = before | {name: value.copy()}
                p[name][place] += step
                slope.append(loss(p, win, label, weight))
            d = (slope[0] - slope[1]) / 2e-5
            if abs(d) > 1e-5:
                moved = net.p[name][place] - value[place]
                assert np.sign(moved) == -np.sign(d), (name, place, d, moved)
                assert abs(abs(moved) - 1e-6) < 1e-7
                checked += 1
    assert checked > 100 and FILTERS * len(WIDTHS) == before["V"].shape[0]


def test_loss_falls():
    rng = np.random.default_rng(5)
    net = ByteConvNet(["a", "b"])
    win = np.concatenate([rng.integers(97, 105, (20, WINDOW)), rng.integers(110, 118, (20, WINDOW))]).astype(np.uint8)
    label = np.repeat([0, 1], 20)
    first = loss(net.p, win, label, np.ones(2))
    net.fit(win, label, epochs=4, batch=10)
    assert loss(net.p, win, label, np.ones(2)) < 0.2 * first
