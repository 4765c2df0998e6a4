"""Sources, and rules of repair, matching and scoring, on small rows with known results."""

import math
import time

import pytest
from pyspark.sql import functions as F

from wrenlake import sources
from wrenlake.functions import text as T
from wrenlake.operators import labels, metrics, motifs, repair


def test_audio_files_and_newest(spark, tmp_path):
    for name in ("a/x.ogg", "a/b/y.wav", "z.txt", "w.mp3"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")
    last = tmp_path / "a" / "last.flac"
    last.write_bytes(b"1")
    import os

    os.utime(last, (time.time() + 60, time.time() + 60))
    files = sources.audio_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["last.flac", "w.mp3", "x.ogg", "y.wav"]
    assert "content" not in files.columns and sources.newest(files).first().path.endswith("last.flac")


def test_observations(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"audio": [{"id": 1, "file_name": "old"}, {"id": 1, "file_name": "a"}, {"id": 2, "file_name": "b"}], "categories": [{"id": 7, "name": "N", "supercategory": "Aves"}], "annotations": [{"audio_id": 1, "category_id": 7}, {"audio_id": 2, "category_id": 8}]}')
    rows = sources.observations(spark, str(path)).collect()
    assert [(r.audio_id, r.file_name, r.name) for r in rows] == [(1, "a", "N")]


def test_allow_list_and_columns(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(" a \n\n# note\nb\n")
    assert sorted(r.value for r in sources.allow_list(spark, str(path)).collect()) == ["a", "b"]
    df = spark.createDataFrame([(1,)], "SPECIES_CODE int")
    assert sources.first_column(df, "species_code") == "SPECIES_CODE" and sources.first_column(df, "x") is None


def test_lists_with_quotes(spark):
    df = spark.createDataFrame([("""["it's", "b"]""",), ("['a', 'b']",), ("[]",), ("oops",), (None,)], "x string")
    assert [r[0] for r in df.select(T.parse_list(F.col("x"))).collect()] == [["it's", "b"], ["a", "b"], [], [], []]


def test_repair(spark):
    rows = spark.createDataFrame([("birdset", "birdset:PER:train:1", " 3 ", "c"), ("birdset", "birdset:PER:train:2", "9", "c"), ("birdset", "birdset:XX", "3", "c"), ("inat", "birdset:PER:1", "3", "c"), ("birdset", "birdset:PER:3", "wren", "c"), (None, None, None, None), ("birdset", "birdset:PER:4", "4", "c")], "source string, source_id string, species_name string, common_name string")
    codes = spark.createDataFrame([("PER", 3, "Abc"), ("PER", 4, "Q")], "config string, number long, code string")
    names = spark.createDataFrame([("abc", "Turdus", "thrush")], "code string, scientific_name string, other_name string")
    got = sorted((r.species_name or "", r.common_name or "", r.repaired) for r in repair.repair_coded(rows, codes, names).collect())
    assert got == sorted([("Turdus", "thrush", True), ("9", "c", False), ("3", "c", False), ("3", "c", False), ("wren", "c", False), ("", "", False), ("Q", "", True)])


def test_external_labels(spark):
    seg = spark.createDataFrame([(1, "a/x.ogg", 0.0), (2, "a/x.ogg", 5.0), (3, "b/y.ogg", 5.04)], "segment int, path string, start double")
    found = spark.createDataFrame([("q/x.ogg", "00:00:05", "s"), ("x.ogg", "0.0", "t"), ("y.ogg", "5", " s "), ("z.ogg", "0", "s")], "path string, start string, species string")
    got = {(r.segment, r.species, r.status) for r in repair.external_labels(seg, found, spark.createDataFrame([("s",)], "species string")).collect()}
    assert got == {(2, "s", "matched"), (1, "t", "unknown"), (3, "s", "matched")}


def test_open_filter(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    frames = spark.createDataFrame([(1, 9.0), (2, 0.0), (3, None), (3, 0.0)], "k int, level double")
    assert sorted(r.k for r in repair.open_filter(keys, "k", frames, "level", 1.0, 0.5).collect()) == [1, 3, 4]


def test_posteriors(spark):
    x = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "id int, v array<double>")
    models = spark.createDataFrame([("a", [(0.5, [0.0, 0.0], [1.0, 1.0]), (0.5, [5.0, 5.0], [1.0, 1.0])]), ("b", [])], "g string, parts array<struct<weight:double,mean:array<double>,var:array<double>>>")
    got = {(r.id, r.g): (r.best, r.entropy) for r in repair.posteriors(x, models, "id", "v", "g").collect()}
    assert got[1, "b"] == got[2, "b"] == (-100.0, 0.0)
    assert got[1, "a"][0] == pytest.approx(1 / (1 + math.exp(-25))) and got[1, "a"][1] < 1e-6


def test_soft_focal_targets(spark):
    rows = spark.createDataFrame([(0.4, 0.6, 1.0), (-0.3, 0.2, 1.0)], "x double, y double, m double")
    want = 0.0
    for x, y in ((0.4, 0.6), (-0.3, 0.2)):
        p = 1 / (1 + math.exp(-x))
        pt, at = (p, 0.25) if y >= 0.5 else (1 - p, 0.75)
        want += at * (1 - pt) ** 2 * -(y * math.log(p) + (1 - y) * math.log(1 - p)) / 2
    assert metrics.focal_loss(rows).first().loss == pytest.approx(want)


def test_missing_frames_and_prototypes(spark):
    protos = spark.createDataFrame([(0, [1.0, 0.0])], "k int, p array<double>")
    seg = spark.createDataFrame([(7, None), (8, []), (9, [[1.0, 0.0]])], "id long, frames array<array<double>>")
    for f in (motifs.soft_assign, motifs.motif_features):
        assert [r.id for r in f(seg, "id", "frames", protos).collect()] == [9]
        assert f(seg, "id", "frames", protos.limit(0)).count() == 0


def test_ranks(spark):
    got = labels.ranked(spark.range(500).withColumnRenamed("id", "k"), "k", 7).collect()
    assert sorted(r.r for r in got) == list(range(500)) and {r.n for r in got} == {500}
