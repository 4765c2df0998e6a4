"""Panels: blocks of neighbours and columns over a graph are dealt to a bounded number of tasks."""

import numpy as np
import pytest

from wrenlake.operators import layout as Y
from wrenlake.operators import neighbours as N


@pytest.mark.parametrize("panels", [1, 5])
def test_product(spark, panels):
    rng = np.random.default_rng(3)
    w = rng.random((40, 40)) * (rng.random((40, 40)) < 0.2)
    w = w + w.T + np.diag(np.full(40, 0.5))
    graph = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w > 0)], "i long, j long, w double")
    own = Y.Panels(graph, panels, 1000)
    x = own.columns(3, 1)
    got = own.rows(own.product(x, 3, lambda y, x, b: (y, x)), 3, np.eye(3)).collect()
    x = {r.i: r[1:] for r in own.rows(x, 3, np.eye(3)).collect()}
    own.close()
    root = np.sqrt(w.sum(1))
    want = w / root[:, None] / root[None] @ np.array([x[i] for i in range(40)])
    assert len(got) == 40 and np.allclose([r[1:] for r in sorted(got)], want)


def test_blocks_sent(spark, monkeypatch):
    """On noise all blocks meet, but each goes to each panel only once."""
    monkeypatch.setattr(N, "PANELS", 3)
    x = np.random.default_rng(1).normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(3)
    _, few, width = N.distinct(df, "i", "v")
    index = N.Index(few, width, 16)
    seen = spark.sparkContext.accumulator(0)
    state = index.blocks.select("block")
    bounds = index.blocks.select("block", "low", "high").selectExpr("*", "1e9D as reach", "0D as floor", "block as alone")
    last = {}

    def visit(s, batch, i):
        s[0] += 1
        if last.get("row") != (id(batch), i):  # a row that is sent is visited by its panel's blocks in turn
            last["row"] = id(batch), i
            seen.add(1)

    met = index.search(state, bounds, lambda b, i: [0], visit, lambda s: iter([N.record("n int", [s[0]])]), "n int")
    assert [r.n for r in met.collect()] == [index.count] * index.count
    assert index.count > 30 and seen.value <= (3 + 1) * index.count
    got = {r.id: [n.id for n in r.near] for r in N.neighbours(index, 7).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.argsort(d[i])[:7].tolist() for i in range(600)}
