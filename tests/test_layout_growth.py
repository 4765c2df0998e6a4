"""What makes the layout's time: distances that are compared one by one, shuffles of a product, lengths taken anew."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenlake.functions import vectors as V
from wrenlake.operators import layout as Y
from wrenlake.operators import neighbours as N


def brute(x, k):
    d = np.stack([N.distance(x, v) for v in x])
    np.fill_diagonal(d, np.inf)
    return {i: [(d[i, j], j) for j in np.argsort(d[i], kind="stable")[:k]] for i in range(len(x))}


def searched(spark, x, k, block):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    _, few, width = N.distinct(df, "i", "v")
    return N.neighbours(N.Index(few, width, block), k)


@pytest.mark.parametrize("at, spread", [(0, 1), (1000, 1e-3), (0, 1e-7), (0, 1e-20), (0, 1e20), (3e15, 1e4)])
def test_candidates_hold_all(at, spread):
    rng = np.random.default_rng(2)
    x, y = (at + spread * rng.normal(size=(n, 9)) for n in (70, 300))
    d = np.stack([N.distance(y, v) for v in x])
    reach = np.sort(d, axis=1)[:, 7]
    half, size = N.halves(x)
    other, sizes = N.halves(y)
    other[:, -1] = sizes / -2
    pairs = N.candidates(half, size, other, sizes, reach)
    if pairs is None:  # all are compared
        assert at > 0 or spread in (1e-20, 1e20)
        return
    found = set(zip(*(p.tolist() for p in pairs)))
    assert {(i, j) for i, j in np.argwhere(d <= reach[:, None]).tolist()} <= found and len(found) < 10 * len(x)


def test_few_pairs_are_compared_one_by_one(spark, monkeypatch):
    compared, plain = spark.sparkContext.accumulator(0), N.nearest

    def counted(x, ids, y, *more):
        compared.add(len(x) * len(y))
        return plain(x, ids, y, *more)

    monkeypatch.setattr(N, "nearest", counted)
    x = np.random.default_rng(1).normal(size=(1600, 12))
    got = {r.id: [(n.d, n.id) for n in r.near] for r in searched(spark, x, 5, 100).collect()}
    assert got == brute(x, 5)
    assert 0 < compared.value < 1600 * 1600 / 4


def test_neighbours_of_tight_groups_and_grids(spark):
    rng = np.random.default_rng(4)
    tight = np.concatenate([c + 1e-6 * rng.normal(size=(60, 4)) for c in 1000 * rng.normal(size=(4, 4))])
    assert {r.id: [(n.d, n.id) for n in r.near] for r in searched(spark, tight, 9, 16).collect()} == brute(tight, 9)
    grid = np.stack(np.meshgrid(*[np.arange(7.0)] * 3), -1).reshape(-1, 3)
    want, got = brute(grid, 6), {r.id: [n.d for n in r.near] for r in searched(spark, grid, 6, 32).collect()}
    assert got == {i: [d for d, _ in w] for i, w in want.items()}


def test_product_shuffles_once(spark):
    rng = np.random.default_rng(3)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 90, (400, 2))}
    graph = spark.createDataFrame([(i, j, 1.0) for i, j in {(j, i) for i, j in links} | links], "i long, j long, w double")
    own = Y.Panels(graph, 5, 1000)
    own.links.count()
    x = own.columns(3, 1)
    before = spark.sparkContext._jsc.sc().newShuffleId()
    y = own.smooth(x, 3, -1.0, 0.2)
    assert spark.sparkContext._jsc.sc().newShuffleId() - before - 1 <= Y.DEGREE
    held = y.repartition(5, "p").groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in held] == [1] * 5  # no task has two panels
    rows, start = ({r.i: np.array(r[1:]) for r in own.rows(s, 3, np.eye(3)).collect()} for s in (y, x))
    own.close()
    ids = sorted(rows)
    w = np.zeros((90, 90))
    for i, j in {(j, i) for i, j in links} | links:
        w[i, j] = 1
    w = w[np.ix_(ids, ids)]
    a = (w / np.sqrt(np.outer(w.sum(1), w.sum(1))) + 0.4 * np.eye(len(ids))) / 0.6
    x = np.array([start[i] for i in ids])
    want, last = a @ x, x
    for _ in range(Y.DEGREE - 1):
        want, last = 2 * a @ want - last, want
    assert np.allclose([rows[i] for i in ids], want)


def test_panels_without_rows(spark):
    graph = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3) if i != j], "i long, j long, w double")
    _, value, away = Y.eigenvectors(graph, 2)
    assert np.allclose(value, [1, -0.5]) and (away < 1e-7).all()


def test_length_is_taken_once(spark):
    def seconds(width):
        v = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i + F.col("id")).cast("double"))
        df = spark.range(0, (1 << 18) // width, 1, 1).select(V.unit(v).alias("v"))
        took = []
        for _ in range(3):
            start = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        return min(took)

    assert seconds(1024) < 4 * seconds(32)
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, []), (4, [0.0])], "i int, v array<double>").select("i", V.unit(F.col("v")).alias("v"))
    assert {r.i: r.v for r in rows.collect()} == {1: [0.6, 0.8], 2: None, 3: [], 4: [0.0]}


def test_panels_of_more_partitions_than_asked_for(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    _, few, width = N.distinct(df, "i", "v")
    plain = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *columns: plain(self, 20 * n, *columns))
    index = N.Index(few, width, 200)
    bounds = index.blocks.select("block", "low", "high").selectExpr("*", "1e9D as reach", "0D as floor", "block as alone")
    met = index.search(index.blocks.select("block"), bounds, lambda b, i: [0], lambda s, b, i: s.__setitem__(0, s[0] + 1), lambda s: iter([N.record("n int", [s[0]])]), "n int")
    assert index.count > 15 and [r.n for r in met.collect()] == [index.count] * index.count
    assert index.parts >= index.count
