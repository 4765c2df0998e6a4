"""Fitted mixtures and their scores against dense formulas; both ways of fitting agree."""

import numpy as np
import pytest

from wrenlake.operators import mixtures as X
from wrenlake.plans import QUERIES
from wrenlake.sources.shared import stash

RNG = np.random.default_rng(8)
MIDDLE = RNG.normal(scale=5, size=(3, 6))


def blobs(n):
    return MIDDLE[RNG.integers(0, 3, n)] + RNG.normal(size=(n, 6)) @ np.diag([1, 0.5, 2, 1, 1, 0.1])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(blobs(300))] + [(900, None, v.tolist()) for v in blobs(90)] + [(901, "one", [0.0] * 6), (902, "two", None)]
    return spark.createDataFrame(data, "i long, g string, v array<double>").repartition(3)


@pytest.fixture(scope="module")
def models(rows):
    return stash(X.group_mixtures(rows, "g", "i", "v"), "models")


def test_both_ways_agree(rows, models):
    many = X.group_mixtures(rows, "g", "i", "v", one_task=10)
    got, want = ({(r.g, r.comp): r for r in m.collect()} for m in (many, models))
    assert got.keys() == want.keys() and len(got) > 3
    for k, r in got.items():
        assert abs(r.weight - want[k].weight) < 1e-6 and r.n_samples == want[k].n_samples
        d = len(r.mean)
        back = [np.array(q.axes).reshape(6, d) for q in (r, want[k])]
        middle = [a @ np.array(q.mean) + np.array(q.centre) for a, q in zip(back, (r, want[k]))]
        spread = [a @ np.array(q["cov"]).reshape(d, d) @ a.T for a, q in zip(back, (r, want[k]))]
        assert np.allclose(*middle, atol=1e-5) and np.allclose(*spread, atol=1e-5)


@pytest.mark.parametrize("most", [1 << 23, 1])
def test_posteriors_are_dense_ones(spark, monkeypatch, rows, models, most):
    monkeypatch.setattr(X, "MOST_NUMBERS", most)
    groups = rows.select("g").distinct()
    got = {(r.i, r.g): r for r in X.mixture_posteriors(rows.where("i < 300"), models, groups, "i", "v", "g").collect()}
    assert len(got) == 300 * 5
    own: dict = {}
    for r in models.collect():
        own.setdefault(r.g, []).append(r)
    assert set(own) == {"a", "b", None}
    for r in rows.where("i < 60").collect():
        for g in ("a", "b", None, "one", "two"):
            if g not in own:
                assert (got[r.i, g].best, got[r.i, g].entropy) == (-100, 0)
                continue
            like = []
            for m in own[g]:
                d = len(m.mean)
                z = (np.array(r.v) - m.centre) @ np.array(m.axes).reshape(6, d) - m.mean
                cov = np.array(m["cov"]).reshape(d, d)
                like.append(np.log(m.weight) - 0.5 * (z @ np.linalg.solve(cov, z) + np.linalg.slogdet(2 * np.pi * cov)[1]))
            q = np.exp(np.array(like) - max(like))
            q /= q.sum()
            w = (q + 1e-10) / (q + 1e-10).sum()
            assert abs(got[r.i, g].best - q.max()) < 1e-9 and abs(got[r.i, g].entropy + (w * np.log(w)).sum()) < 1e-9


def test_query_scores_all_species(spark):
    out = QUERIES["mixture_match"](spark, "/root/testdata/sf0.001").collect()
    assert len({(r.vec_id, r.species) for r in out}) == len(out) == 5000 and all(0 < r.best <= 1 for r in out)
