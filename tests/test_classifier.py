"""The classifier per fold against plain numpy, slopes against differences, areas against ranks."""

import math

import numpy as np
import pytest

from wrenlake.operators import classifier as C


def made(n=240, d=5, c=3, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 2
    y = (x @ rng.normal(size=(d, c)) + rng.normal(size=(n, c)) > 1).astype(float)
    m = (rng.random((n, c)) < 0.7).astype(float)
    fold = rng.integers(-1, 3, n)
    return x, y, m, fold


def frame(spark, x, y, m, fold):
    rows = [(i, None if fold[i] < 0 else int(fold[i]), x[i].tolist(), y[i].tolist(), m[i].tolist(), "c") for i in range(len(x))]
    return spark.createDataFrame(rows, "i long, fold int, x array<double>, y array<double>, m array<double>, turn string").repartition(3)


@pytest.mark.parametrize("loss", C.LOSSES)
def test_slopes(loss):
    rng = np.random.default_rng(1)
    x, y = rng.normal(scale=3, size=400), rng.choice([0, 0.3, 0.7, 1], 400)
    f = C.LOSSES[loss]
    want = (f(x + 1e-6, y)[0] - f(x - 1e-6, y)[0]) / 2e-6
    assert np.allclose(f(x, y)[1], want, atol=1e-5)


def test_gradient_of_layers():
    x, y, m, _ = made(40)
    w = C.start([5, 4, 3], 2)
    got, *_ = C.gradient(w, x, y, m, C.focal)
    for part in range(4):
        for at in list(np.ndindex(w[part].shape))[:6]:
            sides = []
            for step in (1e-6, -1e-6):
                v = [q.copy() for q in w]
                v[part][at] += step
                sides.append(C.gradient(v, x, y, m, C.focal)[1])
            assert abs((sides[0] - sides[1]) / 2e-6 - got[part][at]) < 1e-4


def area(y, p):
    up, down = p[y == 1], p[y == 0]
    return np.mean((up[:, None] > down[None]) + 0.5 * (up[:, None] == down[None]))


def test_same_as_plain_fit(spark):
    x, y, m, fold = made()
    got = C.fit_folds(frame(spark, x, y, m, fold), "i", 3, loss="log", epochs=4, patience=9, rate=0.1)
    kept = {f: max((h for h in got.history if h[0] == f), key=lambda h: (h[3], -h[1])) for f in range(3)}
    for f in range(3):
        on = (fold >= 0) & (fold != f)
        p_by_epoch = {}
        for epoch in range(4):
            w = plain_epochs(x[on], y[on], m[on], epoch + 1, 4)
            z = np.hstack([(x - x[on].mean(0)) / x[on].std(0), np.ones((len(x), 1))])
            p_by_epoch[epoch] = w, 1 / (1 + np.exp(-(z @ w)))
        for _, epoch, _, auc in (h for h in got.history if h[0] == f):
            p = p_by_epoch[epoch][1]
            own = [area(y[(fold == f) & (m[:, j] > 0), j], p[(fold == f) & (m[:, j] > 0), j]) for j in range(3)]
            assert abs(auc - np.mean(own)) < 1e-9
        w = p_by_epoch[kept[f][1]][0]
        assert np.allclose(got.nets[f][0], w[:-1], atol=1e-9) and np.allclose(got.nets[f][1], w[-1:], atol=1e-9)


def plain_epochs(x, y, m, epochs, of):
    """The first ``epochs`` of ``of`` steps."""
    mean, sd = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.vstack([C.start([x.shape[1], y.shape[1]], 42)[0], np.zeros((1, y.shape[1]))])
    a = b = np.zeros_like(w)
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-(z @ w)))
        g = z.T @ ((p - y) * m) / m.sum()
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g**2
        now = 0.1 * 0.5 * (1 + math.cos(math.pi * (t - 1) / of))
        w = w - now * 0.01 * w - now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return w


def test_layers_groups_and_stages(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_TASKS", 1)
    x, y, m, fold = made(300)
    rows = frame(spark, x, y, m, fold)
    got = C.fit_folds(rows, "i", 3, hidden=(8,), epochs=6, patience=2, rate=0.05, groups=2)
    assert max(h[3] for h in got.history) > 0.8
    for f in range(3):  # stops two epochs after the best one, or at the end
        own = [h[3] for h in got.history if h[0] == f]
        assert len(own) == min(6, own.index(max(own)) + 3)
    p = got.scores(rows.select("i", "fold", "x", "y", "m"), "i").collect()
    assert len(p) == 300 and all(0 <= q <= 1 for r in p for q in r.p)


def test_without_rows(spark):
    empty = spark.createDataFrame([], "i long, fold int, x array<double>, y array<double>, m array<double>")
    assert C.fit_folds(empty, "i", 3).nets == {}
    none = frame(spark, *made(30)).selectExpr("i", "fold", "x", "y", "transform(m, v -> 0D) as m")
    got = C.fit_folds(none, "i", 3, epochs=1)
    assert all(h[2:] == (0.0, 0.0) for h in got.history)
