"""The neighbour graph and its eigenvectors against dense ones."""

import numpy as np
import pytest

from wrenlake.operators import layout as Y
from wrenlake.operators import neighbours as N
from wrenlake.sources.shared import stash


def groups(n, width, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(scale=1.5, size=(4, width))
    return (middle[rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])] + rng.normal(size=(n, width))).round(3)


def dense_graph(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    a = np.zeros_like(d)
    for i, near in enumerate(order):
        own = d[i, near]
        over = np.maximum(own - own[own > 0].min(), 0)
        low, high = 1e-9, 1e9
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if np.exp(-over / mid).sum() > np.log2(k) else (mid, high)
        a[i, near] = np.exp(-over / mid)
    return a + a.T - a * a.T


@pytest.fixture(scope="module")
def made(spark):
    x = groups(500, 3, 5)
    x = np.unique(x, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    _, few, width = N.distinct(df, "i", "v")
    return x, stash(Y.neighbour_graph(N.neighbours(N.Index(few, width, 128), 15)), "graph")


def test_graph(made):
    x, graph = made
    want = dense_graph(x, 15)
    got = np.zeros_like(want)
    for r in graph.collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, want, atol=1e-6)


def test_eigenvectors(made):
    x, graph = made
    w = dense_graph(x, 15)
    root = np.sqrt(w.sum(1))
    value, vector = np.linalg.eigh(w / root[:, None] / root[None])
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    rows, got, away = Y.eigenvectors(graph, 4)
    assert np.allclose(got, value, atol=1e-7) and (away < 1e-6).all()
    found = {r.i: r[1:] for r in rows.collect()}
    z = np.array([found[i] for i in range(len(x))])
    for c in range(4):
        assert z[np.abs(z[:, c]).argmax(), c] > 0
        sign = np.sign(z[:, c] @ vector[:, c])
        gap = np.abs(np.delete(value, c) - value[c]).min()
        assert np.allclose(z[:, c], sign * vector[:, c], atol=1e-5 / gap * 1e-2)


def test_layout_of_copies_and_few(spark):
    x = groups(40, 2, 1)
    x[10:14] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [float("nan")] * 2)], "i long, v array<double>").repartition(2)
    z = {r.i: r.z for r in Y.spectral_layout(df, "i", "v", 2, 8, "euclid", turns=1).collect()}
    assert sorted(z) == list(range(40)) and z[10] == z[13] and len({tuple(v) for v in z.values()}) == 37
    few = {r.i: r.z for r in Y.spectral_layout(df.where("i < 3"), "i", "v", 2, 8).collect()}
    assert few == {i: [0.0, 0.0] for i in range(3)}
    assert Y.spectral_layout(df.where("i > 90"), "i", "v").collect() == []

