"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from wrenlake import plans
from wrenlake.plans import relational

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(plans.SQL))
def test_same_as_sql(spark, db, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = db.execute(plans.SQL[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_whole_core_distances(spark):
    rows = plans.QUERIES["core_distance"](spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x = np.stack(table.embedding.to_numpy()).astype(float)
    d = dict(zip(table.vec_id, np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 10]))
    assert len(rows) == len(d) and all(abs(r.dist - d[r.vec_id]) < 2e-6 for r in rows)


@pytest.mark.parametrize(("name", "width"), [("mixup", 64), ("subcluster_match", None)])
def test_whole_vectors_same_as_sql(spark, db, name, width):
    df = plans.QUERIES[name](spark, FOLDER)
    got = {tuple(r)[:2]: r[2] for r in df.collect()}
    want = {r[:2]: r[2] for r in db.execute(plans.SQL[name]).fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x, y = np.stack(table.embedding.to_numpy()).astype(float), table.label.to_numpy()
    if width:
        assert {i for _, i in got} == set(range(width)) and len(got) == width * len(x)
    else:
        for g in set(y):
            mean, var = x[y == g].mean(0), x[y == g].var(0) + 1e-3
            own = -0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var).sum(1)
            assert all(abs(got[v, g] - q) < 1e-5 for v, q in zip(table.vec_id, own))


@pytest.mark.parametrize("name", ["taxonomy_lookup", "coalesce_lookup"])
def test_lookups_same_as_sql(spark, db, name):
    rows = [tuple(r) for r in plans.QUERIES[name](spark, FOLDER).collect()]
    assert sorted(rows) == sorted(db.execute(plans.SQL[name]).fetchall())
    if name == "taxonomy_lookup":
        assert all(r[2] == "strong_primary" for r in rows)


def test_lookup_misses(spark):
    nation = spark.createDataFrame([(1, "A", 7), (24, "B", 8)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(7, "R")], "r_regionkey int, r_name string")
    customer = spark.createDataFrame([(1, 24), (2, 25), (3, None)], "c_custkey int, c_nationkey int")
    supplier = spark.createDataFrame([(1, 1), (2, 24), (3, 25)], "s_suppkey int, s_nationkey int")
    got = sorted(tuple(r) for r in relational.taxonomy(customer, nation).collect())
    assert got == [(1, "B", "strong_primary"), (2, "", "unlabeled"), (3, "", "unlabeled")]
    assert sorted(tuple(r) for r in relational.first_name(supplier, nation, region).collect()) == [(1, "R"), (2, "B"), (3, "25")]
