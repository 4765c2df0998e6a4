"""Streams whose state ends, caps and keys over restarts, and tables rewritten in place."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wrenlake import streaming as S
from wrenlake.operators import motifs
from wrenlake.sources.rewrite import Table
from wrenlake.sources.shared import new_dir


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_windows_close_and_state_is_dropped(spark):
    base, folder = dt.datetime(2024, 1, 1), new_dir(spark, "in")
    rows = [(base + dt.timedelta(minutes=7 * i % 600), float(i)) for i in range(200)]
    put(spark, folder, rows, "ts timestamp, value double")

    def build(x):
        x = x.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"))
        return x.select(F.col("w.start").alias("start"), "n")

    out, (first, second) = S.run_to_end(source(spark, folder, "ts timestamp, value double"), "ts", build, S.new_sink(spark))
    want: dict = {}
    for t, _ in rows:
        key = t - dt.timedelta(minutes=t.minute % 5)
        want[key] = want.get(key, 0) + 1
    got = out.collect()
    assert {r.start: r.n for r in got} == want and len(got) == len(want)  # each once
    held = [[p["stateOperators"][0]["numRowsTotal"] for p in run if p["stateOperators"]] for run in (first, second)]
    assert max(held[0]) == len(want) and held[1][-1] == 1  # the closing row's


def test_nothing_to_close(spark):
    folder = new_dir(spark, "in")
    spark.createDataFrame([], "ts timestamp, value double").write.parquet(folder)
    out, reports = S.run_to_end(source(spark, folder, "ts timestamp, value double"), "ts", lambda x: x.withWatermark("ts", "1 minute").groupBy(F.window("ts", "1 minute")).count().select("count"), S.new_sink(spark))
    assert out.collect() == [] and len(reports) == 1


def test_cap_over_restarts(spark):
    folder, sink = new_dir(spark, "in"), S.new_sink(spark)
    schema = "g string, i long"
    taken = []
    for turn, rows in enumerate(([("a", 5), ("a", 3), ("b", 1), (None, 9)], [("a", 1), ("a", 2), ("a", 4), ("b", 2)], [("a", 0), (None, 7), (None, 8), (None, 6)])):
        put(spark, folder, rows, schema)
        S.run_all(S.capped(source(spark, folder, schema), "g", "i", 3), f"{sink}/out", f"{sink}/log")
        taken.append({(r.g, r.i) for r in spark.read.schema(schema).parquet(f"{sink}/out").collect()})
    assert taken[0] == {("a", 3), ("a", 5), ("b", 1), (None, 9)}
    assert taken[1] - taken[0] == {("a", 1), ("b", 2)}
    assert taken[2] - taken[1] == {(None, 6), (None, 7)}


def test_keys_over_restarts_and_replays(spark):
    folder, sink = new_dir(spark, "in"), S.new_sink(spark)
    schema = "k long, g string, x long"
    store = S.KeyStore(sink, ["k", "g"], buckets=64)
    for rows in ([(1, "a", 5), (1, "a", 4), (2, None, 1)], [(1, "a", 0), (3, "b", 7), (2, None, 9), (2, "c", 3)]):
        put(spark, folder, rows, schema)
        S.run_once_each(source(spark, folder, schema), store, f"{sink}/log")
    want = {(1, "a", 4), (2, None, 1), (3, "b", 7), (2, "c", 3)}

    def held():
        got = [tuple(r) for r in store.rows(spark, schema).collect()]
        assert len(got) == len(set(got))
        return set(got)

    assert held() == want
    store.accept(spark.createDataFrame([(1, "a", 0), (3, "b", 7), (2, None, 9), (2, "c", 3)], schema), 1)  # the second batch again
    assert held() == want
    store.accept(spark.createDataFrame([], schema), 2)
    store.accept(spark.createDataFrame([(3, "b", 7), (4, "d", 1)], schema), 3)
    assert held() == want | {(4, "d", 1)}


def test_a_batch_reads_its_buckets_only(spark):
    sink = S.new_sink(spark)
    store = S.KeyStore(sink, ["k"], buckets=64)
    store.accept(spark.range(2000).withColumnRenamed("id", "k"), 0)
    files = store.held(spark, "k long", 1, [5, 6]).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {"5", "6"}
    every = store.held(spark, "k long", 1, list(range(64)))
    assert every.count() == 2000 and len(files) < len(every.inputFiles()) / 20
    assert store.held(spark, "k long", 0, [5, 6]).count() == 0  # a batch doesn't see itself


class Died(Exception):
    pass


@pytest.mark.parametrize("step", range(5))
def test_rewrite_dies(spark, monkeypatch, step):
    path = new_dir(spark, "table")
    spark.range(5).write.parquet(path)
    table = Table(spark, path)
    done = [0]

    def dies(f):
        def run(*a):
            if done[0] == step:
                raise Died
            done[0] += 1
            return f(*a)

        return run

    def change(x):
        if step == 0:
            raise Died
        return x.selectExpr("id * 10 as id")

    done[0] = 1
    monkeypatch.setattr(table, "move", dies(table.move))
    if step == 4:
        done[0] = -10  # all steps are done
    elif step == 3:
        monkeypatch.setattr(table, "drop", lambda p, f=table.drop: (_ for _ in ()).throw(Died) if table.exists(table.old) and not table.exists(table.new) else f(p))
    try:
        table.rewrite(change)
        assert step == 4
    except Died:
        assert step < 4
    found = Table(spark, path)
    new = step >= 2
    assert sorted(r.id for r in found.read().collect()) == [i * (10 if new else 1) for i in range(5)]
    assert not found.exists(found.old) and not found.exists(found.new)
    found.rewrite(lambda x: x.selectExpr("id + 1 as id"))
    assert sorted(r.id for r in found.read().collect()) == [i * (10 if new else 1) + 1 for i in range(5)]


def test_half_written_goes(spark):
    path = new_dir(spark, "table")
    spark.range(3).write.parquet(path)
    spark.range(9).write.parquet(f"{path}.new")
    table = Table(spark, path)
    table.drop(f"{path}.new/_SUCCESS")
    assert table.read().count() == 3 and not table.exists(table.new)


def test_runs(spark):
    rows = [([0.2, 0.3, 0.0, 0.4, 0.4, 0.4], (5 / 6, 2, 3)), ([0.0, 0.1], (0.0, 0, 0)), ([0.5], (1.0, 1, 1)), ([None, 0.5], (0.5, 1, 1))]
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(rows)], "i long, w array<double>")
    got = {r.i: tuple(r.r) for r in df.select("i", motifs.runs(F.col("w"), 0.1).alias("r")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
