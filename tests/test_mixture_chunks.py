"""An expectation step holds a bounded number of rows' differences, and sums the same as all rows at once."""

import tracemalloc

import numpy as np

from wrenlake.operators import mixtures as X


def test_expect_in_chunks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_001, 16))
    x[:500] += 60  # shares of the far component are exactly 0 or 1
    means = np.stack([x[600], x[700], np.full(16, 60.0)])
    mixture = np.array([0.5, 0.3, 0.2]), means, np.stack([np.eye(16), 2 * np.eye(16), np.eye(16)])
    X.expect(x[:600], mixture)
    tracemalloc.start()
    total, shares, moved, outer = X.expect(x, mixture)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
    far = x[:, None] - means[None]
    var = np.array([1.0, 2.0, 1.0])
    logs = np.log(mixture[0]) - 0.5 * (far**2).sum(2) / var - 8 * np.log(2 * np.pi * var)
    norm = np.logaddexp.reduce(logs, axis=1)
    r = np.exp(logs - norm[:, None])
    assert np.isclose(total, norm.sum()) and np.allclose(shares, r.sum(0))
    assert np.allclose(moved, np.einsum("nk,nkd->kd", r, far)) and np.allclose(outer, np.einsum("nk,nkd,nke->kde", r, far, far))
