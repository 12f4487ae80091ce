import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tickloom.operators.bitemporal import day_number, locate, near_periods, rectangles

D0 = date(2020, 1, 1)


def versions(spark, rows):
    return spark.createDataFrame([(k, D0 + timedelta(p), D0 + timedelta(r), v) for k, p, r, v in rows], "k string, p date, r date, x bigint")


def known(rows, key, valid, recorded):
    """The value by looking at everything recorded before."""
    seen = [(p, r, x) for k, p, r, x in rows if k == key and r < recorded and p <= valid]
    return max(seen, default=(None, None, None))[2]


def test_regions_give_what_was_known(spark):
    rng = random.Random(3)
    rows = list({(k, p, r): (k, p, r, i) for i in range(120) for k, p, r in [(rng.choice("ab"), rng.randrange(0, 2000, 90), rng.randrange(0, 2500, 7))]}.values())
    regions = rectangles(versions(spark, rows), ["k"], "p", "r", "x")
    base = (D0 - date(1970, 1, 1)).days
    points = [(k, base + v, base + r) for k in "abc" for v in range(-50, 2600, 61) for r in range(-50, 2600, 97)]
    df = spark.createDataFrame(points, "k string, v int, r int")
    got = {(x.k, x.v, x.r): x.value for x in locate(df, regions, ["k"], "v", "r").collect()}
    assert got == {(k, v, r): w for k, v, r in points if (w := known(rows, k, v - base, r - base)) is not None}
    diagonal = {(x.k, x.v): x.value for x in locate(df, regions, ["k"], "v", "v").collect()}
    assert diagonal == {(k, v): w for k, v, _ in points if (w := known(rows, k, v - base, v - base)) is not None}
    area = regions.collect()
    assert len(area) <= 2 * len(rows)
    for a in area:
        assert not any(a is not b and a.k == b.k and a.v0 < b.v1 and b.v0 < a.v1 and a.r0 < b.r1 and b.r0 < a.r1 for b in area)


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", D0, D0, 1), ("a", D0, D0, 1), ("a", None, D0, 2), ("a", D0, None, 3), (None, D0, D0, 4), ("a", D0, D0, None)], "k string, p date, r date, x bigint")
    assert [(r.value, r.r0) for r in rectangles(df, ["k"], "p", "r", "x").collect()] == [(1, (D0 - date(1970, 1, 1)).days + 1)]
    assert rectangles(df.limit(0), ["k"], "p", "r", "x").count() == 0
    points = spark.createDataFrame([("a", None), (None, 5)], "k string, v int")
    assert locate(points, rectangles(df, ["k"], "p", "r", "x"), ["k"], "v", "v").count() == 0


def test_periods_are_chains(spark):
    df = spark.createDataFrame([("a", D0 + timedelta(d)) for d in (0, 3, 7, 12, 12)] + [("a", None), ("b", D0)], "k string, d date")
    got = sorted((r.k, (r.d - D0).days, (r.p - D0).days) for r in near_periods(df, ["k"], "d", 4, "p").where("d is not null").collect())
    assert got == [("a", 0, 0), ("a", 3, 0), ("a", 7, 0), ("a", 12, 12), ("a", 12, 12), ("b", 0, 0)]
    assert near_periods(df, ["k"], "d", 4, "p").where("d is null and p is null").count() == 1
    assert spark.createDataFrame([(date(1969, 12, 31),)], "d date").select(day_number(F.col("d")).alias("n")).first().n == -1
