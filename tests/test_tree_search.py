"""The spanning tree searches only for rows that may have an edge they don't know."""

import numpy as np

from wrenlake.operators import density as D
from wrenlake.operators import neighbours as N

from .test_density import brute_tree, frame


def test_known_edges_spare_searches(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 3))
    _, few, width = N.distinct(frame(spark, x), "i", "v")
    index = N.Index(few, width, 64)
    near = N.neighbours(index, 6).persist()
    shares, search = [], N.Index.search

    def counted(self, own, bounds, begin, visit, finish, schema, share=1.0, *more):
        shares.append(share)
        return search(self, own, bounds, begin, visit, finish, schema, share, *more)

    monkeypatch.setattr(N.Index, "search", counted)
    tree = D.spanning_tree(index, near, 5)
    assert sorted((r.w, r.lo, r.hi) for r in tree.collect()) == sorted(brute_tree(x, 5))
    assert sum(shares) < 1.5 and all(s < 0.8 for s in shares), shares
