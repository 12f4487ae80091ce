from datetime import date

import pytest
from pyspark.sql import functions as F

from tickloom.operators.grid import period_number, period_start, regularize


def test_periods(spark):
    cases = [("D", "2024-01-05", "2024-01-05"), ("D", "2024-01-06", None), ("W", "2024-01-07", "2024-01-01"), ("W", "1969-12-28", "1969-12-22"), ("M", "2024-02-29", "2024-02-01"), ("Q", "1969-12-31", "1969-10-01"), ("X", "2024-01-01", None)]
    df = spark.createDataFrame(cases, "f string, d string, want string").withColumn("n", period_number(F.to_date("d"), F.col("f")))
    got = df.select("want", period_start(F.col("n"), F.col("f")).cast("string").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    friday, monday = (spark.createDataFrame([(d,)], "d string").select(period_number(F.to_date("d"), F.lit("D")).alias("n")).first().n for d in ("2024-01-05", "2024-01-08"))
    assert monday == friday + 1


def grid(spark, rows, gap=3):
    df = spark.createDataFrame([(k, date.fromisoformat(d) if d else None, v, i, "x") for i, (k, d, v) in enumerate(rows)], "k string, d date, v double, i bigint, run string")
    out = regularize(df, "k", "d", "v", F.lit("D"), ["i"], gap)
    return {(r.k, str(r.period)): (r.value, r.missing, r.run, r.filled) for r in out.collect()}


def test_gaps_are_marked_and_filled(spark):
    got = grid(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0), ("a", "2024-01-04", 5.0), ("a", "2024-01-03", None), ("a", "2024-01-15", 9.0), ("a", None, 3.0), (None, "2024-01-01", 1.0), ("n", "2024-01-01", None)])
    assert got["a", "2024-01-01"] == (2.0, False, 0, 2.0)
    assert got["a", "2024-01-02"] == (None, True, 2, pytest.approx(3.0))
    assert got["a", "2024-01-03"] == (None, True, 2, pytest.approx(4.0))
    assert got["a", "2024-01-05"] == (None, True, 6, None)
    assert len(got) == 11 and all(k == "a" for k, _ in got)


def test_empty(spark):
    assert grid(spark, []) == {}
