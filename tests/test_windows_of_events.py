"""Windows about events, and draws by number within large groups."""

from pyspark.sql import functions as F

from wrenlake.operators import repair, segments


def test_event_window(spark):
    rows = [(4.0, 5.0, 20.0, (2.0, 7.0)), (1.0, 2.0, 20.0, (0.0, 5.0)), (18.0, 19.0, 20.0, (15.0, 20.0)), (1.0, 2.0, 3.0, (0.0, 3.0)), (2.0, 14.0, 20.0, (2.0, 8.0)), (0.0, 0.0, 20.0, (0.0, 2.5)), (3.0, 8.0, 9.0, (3.0, 8.0))]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)] + [(99, None, 1.0, 9.0)], "i int, s double, e double, t double")
    a, b = segments.event_window(F.col("s"), F.col("e"), F.col("t"), 5.0, 6.0)
    got = {r.i: (r.a, r.b) for r in df.select("i", a.alias("a"), b.alias("b")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_draw_from_a_large_group(spark):
    rows = spark.createDataFrame([(i, "a" if i % 10 else f"g{i % 7}") for i in range(3000)], "k long, g string")
    drawn = repair.balanced_draw(rows, "k", "g", spark.range(4000).withColumnRenamed("id", "draw")).join(rows, "k").collect()
    assert len(drawn) == len({r.draw for r in drawn}) == 4000
    count: dict = {}
    for r in drawn:
        count[r.g] = count.get(r.g, 0) + 1
    assert len(count) == 8 and all(380 < n < 620 for n in count.values())
    assert len({r.k for r in drawn if r.g == "a"}) > 400
