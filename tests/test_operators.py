"""Operators against values worked out by hand or by plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrenlake.functions import text as T
from wrenlake.operators import labels, metrics, mixtures, motifs, neighbours, segments


@pytest.mark.parametrize(
    ("duration", "overlap", "expected"),
    [(12.3, 0, [(0, 5), (5, 10)]), (15.0, 0, [(0, 5), (5, 10), (10, 15)]), (9.995, 0, [(0, 5), (5, 9.995)]), (4.99, 0, [(0, 4.99)]), (4.98, 0, []), (0.0, 0, []), (12.3, 2.5, [(0, 5), (2.5, 7.5), (5, 10)])],
)
def test_fixed_segments(spark, duration, overlap, expected):
    rows = segments.fixed_segments(spark.createDataFrame([(duration,)], "d double"), "d", 5.0, overlap).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == expected


def test_no_endless_overlap(spark):
    with pytest.raises(ValueError):
        segments.fixed_segments(spark.createDataFrame([(1.0,)], "d double"), "d", 5.0, 5.0)


def test_label_masks(spark):
    rows = [(1, "unlabeled", [], []), (2, "strong_multilabel", ["a", "c"], []), (3, "strong_multilabel", ["a", "zzz"], []), (4, "strong_primary", ["a"], ["b"]), (5, "strong_primary", ["zzz"], ["b"]), (6, "other", ["a"], [])]
    df = spark.createDataFrame(rows, "segment int, quality string, primary array<string>, secondary array<string>")
    got = {}
    for r in labels.label_masks(df, ["a", "b", "c"]).orderBy("segment", "species").collect():
        got.setdefault(r.segment, []).append((r.y, r.m))
    y = {1: [0, 0, 0], 2: [1, 0, 1], 3: [1, 0, 0], 4: [1, 1, 0], 5: [0, 0, 0], 6: [0, 0, 0]}
    m = {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    assert got == {k: [(v, m[k]) for v in y[k]] for k in y}


def test_soft_assignment(spark):
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "k int, p array<double>")
    seg = spark.createDataFrame([(7, [[1.0, 0.0], [0.0, 1.0]])], "id long, frames array<array<double>>")
    rows = motifs.motif_features(seg, "id", "frames", protos).orderBy("k").collect()
    assert [round(r.hist, 6) for r in rows] == [0.949260, 0.949260, 0.101479]
    assert [round(r.mx, 6) for r in rows] == [0.949217, 0.949217, 0.050740]
    assert [round(r.spread, 6) for r in rows] == [0.474587, 0.474587, 0.0]
    assert round(rows[0].noise, 6) == 0.183105
    assert motifs.dominant(spark.createDataFrame(rows), "id").first().k == 0


def test_auc_and_purity(spark):
    rows = [("a", s, y) for s, y in zip([0.9, 0.8, 0.8, 0.3, 0.3], [1, 0, 1, 0, 1])] + [("b", 0.5, 1)]
    got = metrics.auc_by_class(spark.createDataFrame(rows, "c string, s double, y int"), "c", "s", "y").collect()
    assert [(r.c, round(r.auc, 6)) for r in got] == [("a", 0.666667)]
    counts = spark.createDataFrame([(0, "x", 3.0), (0, "y", 1.0), (1, "x", 4.0), (2, "x", 2.0), (2, "y", 2.0), (2, "z", 2.0)], "k int, species string, n double")
    got = {r.k: round(r.purity, 6) for r in motifs.purity(counts, 3).collect()}
    assert got == {0: 0.488140, 1: 1.0, 2: 0.0}


def test_losses(spark):
    rows = spark.createDataFrame([(2.0, 1.0, 1.0), (-1.0, 0.0, 1.0), (0.0, 1.0, 0.0)], "x double, y double, m double")
    assert round(metrics.focal_loss(rows).first().loss, 6) == 0.008722
    assert round(metrics.asymmetric_loss(rows).first().loss, 6) == 0.064283


def test_parsing(spark):
    df = spark.createDataFrame([("['x', '12345']", "01:02:03.5", "XC00123.ogg"), ("oops", "02:03", "000.ogg"), (None, "7.5", "")], "a string, b string, c string")
    rows = df.select(T.parse_list(F.col("a")).alias("a"), T.seconds(F.col("b")).alias("b"), T.catalogue_id(F.col("c")).alias("c")).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(["x", "12345"], 3723.5, "123"), ([], 123.0, "0"), ([], 7.5, None)]


def test_group_folds_are_even(spark):
    folds = labels.group_folds(spark.range(1003).withColumnRenamed("id", "g"), "g")
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003


def test_mixture_finds_blobs():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    assert len(mixtures.choose_mixture(x)[2][0]) == 3
    assert mixtures.choose_mixture(x[:1]) is None


def test_box(spark):
    df = spark.createDataFrame([(-22.0, -62.0), (-9.99, -50.0), (None, -50.0)], "a double, b double")
    assert [r[0] for r in df.select(segments.in_box(F.col("a"), F.col("b"), (-22, -62, -10, -44))).collect()] == [True, False, False]


@pytest.mark.parametrize("block", [7, 2048])
def test_core_distances(spark, block):
    x = np.random.default_rng(3).normal(size=(50, 5))
    x[10:13] = x[9]  # copies
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, v array<double>").repartition(3)
    for k in (3, 10):
        got = {r.vec_id: r.dist for r in neighbours.core_distances(df, "vec_id", "v", k, block).collect()}
        assert sorted(got) == list(range(50))
        assert all(abs(got[i] - np.sort(d[i])[k]) < 1e-9 for i in range(50))
    assert neighbours.core_distances(df.limit(3), "vec_id", "v", 10).count() == 0


def test_group_mixtures_use_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, (rng.normal(((0, 0, 0), (3, 0, 1), (0, 3, 2))[i % 3], 0.1, 3)).tolist()) for g, n in (("a", 20_100), ("b", 90), (None, 60), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").repartition(4)
    got = mixtures.group_mixtures(df, "g", "id", "v").collect()
    assert {r.g: r.n_samples for r in got} == {"a": 20_100, "b": 90, None: 60}
    assert sorted(round(r.weight, 3) for r in got if r.g == "a") == [0.333] * 3
    some = df.where("g is null or g <> 'a'")
    one, many = (sorted((str(r.g), round(r.weight, 4), r.n_samples) for r in mixtures.group_mixtures(some, "g", "id", "v", one_task=m).collect()) for m in (20_000, 10))
    assert one == many
