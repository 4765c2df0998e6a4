"""Fitted models' queries give every row a result."""

from wrenlake.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_fold_scores(spark):
    rows = QUERIES["fold_scores"](spark, FOLDER).collect()
    assert len({(r.vec_id, r.j) for r in rows}) == len(rows) == 5000
    assert all(r.fold == r.vec_id % 5 and 0 <= r.p <= 1 for r in rows)
