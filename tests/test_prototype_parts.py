"""Prototypes taken in parts give what they give at once."""

import numpy as np
import pytest

from wrenlake.operators import motifs


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_parts_agree(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(1 + i % 4, 3)).tolist()) for i in range(30)] + [(90, None), (91, [])]
    segments = spark.createDataFrame(rows, "i long, frames array<array<double>>").repartition(3)
    prototypes = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(12)], "k int, p array<double>")

    def made():
        a = motifs.soft_assign(segments, "i", "frames", prototypes, metric=metric)
        b = motifs.motif_features(segments, "i", "frames", prototypes, metric=metric)
        c = motifs.traces(segments, "i", "frames", prototypes, metric=metric)
        return [sorted(((*r[: n], *np.ravel(r[n:]).tolist()) if n else tuple(r) for r in df.collect())) for df, n in ((a, 3), (b, 2), (c, 2))]

    whole = made()
    monkeypatch.setattr(motifs, "MOST_NUMBERS", 9)
    for got, want in zip(made(), whole):
        assert len(got) == len(want) > 300 and np.allclose([x for r in got for x in r], [x for r in want for x in r], atol=1e-9)
    assert motifs.soft_assign(segments, "i", "frames", prototypes.where("k < 0")).collect() == []
