"""Exact neighbours and density clusters against dense brute force, copies, ties and awkward rows included."""

import numpy as np
import pytest

from wrenlake.operators import density as D
from wrenlake.operators import neighbours as N
from wrenlake.plans import QUERIES, learning

FOLDER = "/root/testdata/sf0.001"


def far(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def brute_tree(x, k):
    """Edges of the spanning tree of mutual reachability in order."""
    d = far(x)
    core = np.sort(d, axis=1)[:, k]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    i, j = np.triu_indices(len(x), 1)
    over = list(range(len(x)))

    def find(a):
        while over[a] != a:
            a = over[a]
        return a

    out = []
    for e in np.lexsort((j, i, w[i, j])):
        a, b = find(i[e]), find(j[e])
        if a != b:
            over[b] = a
            out.append((w[i[e], j[e]], int(i[e]), int(j[e])))
    return out


def brute_clusters(x, smallest, k):
    """Labels by the whole dendrogram, top down."""
    n = len(x)
    over, node, size, kids = list(range(n)), list(range(n)), dict.fromkeys(range(n), 1), {}

    def find(a):
        while over[a] != a:
            a = over[a]
        return a

    for w, i, j in brute_tree(x, k):
        a, b = find(i), find(j)
        new = n + len(kids)
        kids[new], size[new] = (node[a], node[b], w), size[node[a]] + size[node[b]]
        over[b], node[a] = a, new

    def points(v):
        return [v] if v < n else points(kids[v][0]) + points(kids[v][1])

    top = n + len(kids) - 1
    parent, birth, stability, fell, todo = {top: None}, {top: 0.0}, {top: 0.0}, {}, [(top, top)]
    while todo:
        v, c = todo.pop()
        if v < n:
            continue
        *sides, w = kids[v]
        lasted = 1 / max(w, 1e-9)
        big = [size[u] >= smallest for u in sides]
        for u, is_big in zip(sides, big):
            if all(big):
                parent[u], birth[u], stability[u] = c, lasted, 0.0
                todo.append((u, u))
            elif is_big:
                todo.append((u, c))
            else:
                fell |= dict.fromkeys(points(u), c)
            if all(big) or not is_big:
                stability[c] += size[u] * (lasted - birth[c])
    best, wins = {}, {}
    for c in sorted(parent):
        under = sum(best[q] for q in parent if parent[q] == c)
        wins[c], best[c] = stability[c] >= under, max(stability[c], under)
    label = {}
    for c in sorted(parent, reverse=True):
        p = parent[c]
        label[c] = None if p is None else label[p] if label[p] is not None else c if wins[c] else None
    number = {}
    for p in range(n):
        if label[fell[p]] is not None:
            number.setdefault(label[fell[p]], len(number))
    return [number.get(label[fell[p]], -1) for p in range(n)]


def groups(n, width, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(scale=4, size=(6, width))
    x = np.round(middle[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * rng.choice([0.3, 1.0], size=(n, 1)), 3)
    x[50:70], x[80:83] = x[50], x[80]
    return x


def frame(spark, x):
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    width = x.shape[1]
    odd = [(9000, None, ""), (None, [0.0] * width, ""), (9001, [None] * width, ""), (9002, [float("nan")] * width, ""), (9003, [0.0], ""), (9004, [], "")]
    return spark.createDataFrame(rows + odd, "i long, v array<double>, id string").repartition(3)


@pytest.mark.parametrize(("width", "block"), [(3, 32), (64, 150)])
def test_neighbours(spark, width, block):
    x = groups(400, width, 1)
    got = {r.i: r.dist for r in N.core_distances(frame(spark, x), "i", "v", 10, block).collect()}
    want = np.sort(far(x), axis=1)[:, 10]
    assert sorted(got) == list(range(400)) and np.allclose([got[i] for i in range(400)], want, rtol=0, atol=1e-12)


def test_far_blocks_are_left_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(scale=50, size=(20, 3))[rng.integers(0, 20, 800)] + rng.normal(size=(800, 3))
    _, few, width = N.distinct(frame(spark, x), "i", "v")
    index = N.Index(few, width, 40)
    ranges = index.blocks.select("block", "low", "high").selectExpr("*", "8D as reach", "0D as floor", "block as alone")
    met = sum(len(r.others) for r in index.near_blocks(ranges).collect())
    assert index.count >= 20 and met < 0.3 * index.count**2


def test_slices_of_bounds(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 3)
    x = groups(200, 2, 3)
    got = {r.i: r.dist for r in N.core_distances(frame(spark, x), "i", "v", 4, 16).collect()}
    assert np.allclose([got[i] for i in range(200)], np.sort(far(x), axis=1)[:, 4], rtol=0, atol=1e-12)


def test_few_rows(spark):
    one = frame(spark, np.ones((1, 2)))
    assert N.core_distances(one, "i", "v", 1).collect() == []
    same = frame(spark, np.ones((30, 2)))
    assert {r.dist for r in N.core_distances(same, "i", "v", 3).collect()} == {0.0}
    assert {r.cluster for r in D.density_clusters(same, "i", "v", 5, 3).collect()} == {-1}
    assert D.density_clusters(one.where("i > 9003"), "i", "v").collect() == []


def test_spanning_tree(spark):
    x = np.unique(groups(150, 3, 4), axis=0)
    _, few, width = N.distinct(frame(spark, x), "i", "v")
    index = N.Index(few, width, 32)
    tree = D.spanning_tree(index, N.neighbours(index, 5).persist(), 5)
    assert sorted((r.w, r.lo, r.hi) for r in tree.collect()) == sorted(brute_tree(x, 5))


@pytest.mark.parametrize("most", [80, 1 << 14])
def test_density_clusters(spark, monkeypatch, most):
    if most == 80:
        monkeypatch.setattr(D, "CLUSTERS", 0)
    x = groups(300, 3, 1)
    got = {r.i: r.cluster for r in D.density_clusters(frame(spark, x), "i", "v", 12, 10, 64, most).collect()}
    want = brute_clusters(x, 12, 10)
    assert [got[i] for i in range(300)] == want and 1 < max(want) and -1 in want


def test_pick():
    clusters = [("r", None, 9.0), ("a", "r", 3.0), ("b", "r", 5.0), ("c", "b", 2.0), ("d", "b", 3.0), ("e", "a", 2.0), ("f", "a", 2.0)]
    assert D.pick(clusters) == {"b": "b", "c": "b", "d": "b", "e": "e", "f": "f"}


def test_query_clusters(spark):
    rows = QUERIES["density_clusters"](spark, FOLDER).collect()
    z = {r.vec_id: r.z for r in learning.reduced(spark, FOLDER).collect()}
    order = sorted(z)
    want = brute_clusters(np.array([z[i] for i in order]), 50, 10)
    got = {r.vec_id: r.cluster for r in rows}
    assert [got[i] for i in order] == want
