import random
from datetime import date, datetime, timedelta

import pytest

from tickloom.operators.rolling import latest, trailing_totals

D0 = date(2023, 12, 20)


def test_totals_against_plain_sums(spark):
    rng = random.Random(7)
    rows = {(k, d): (rng.randrange(100), rng.random()) for k in ("a", "b", "late") for d in rng.sample(range(400), 25)}
    df = spark.createDataFrame([(k, D0 + timedelta(d), v, w, 1) for (k, d), (v, w) in rows.items()], "k string, day date, v bigint, w double, _at int")
    got = {(r.k, (r.day - D0).days): (r.v_7, r.v_30, r.w_7, r.w_30) for r in trailing_totals(df, "k", "day", ["v", "w"], [7, 30], tail=6).collect()}
    want = {}
    for k in ("a", "b", "late"):
        days = [d for kk, d in rows if kk == k]
        for d in range(min(days), max(days) + 7):
            pick = lambda i, n: sum(rows[k, e][i] for e in range(d - n + 1, d + 1) if (k, e) in rows)
            want[k, d] = (pick(0, 7), pick(0, 30), pick(1, 7), pick(1, 30))
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key] == pytest.approx(w, abs=1e-9)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", D0, None), (None, D0, 5), ("b", None, 5)], "k string, day date, v bigint")
    got = trailing_totals(df, "k", "day", ["v"], [7], tail=0).collect()
    assert [(r.k, r.day, r.v_7) for r in got] == [("a", D0, 0.0)]
    assert trailing_totals(df.limit(0), "k", "day", ["v"], [7, 30], tail=6).count() == 0


def test_latest_of_a_reading(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, None, 1, 10), ("a", t, t, 2, None), ("a", t, t, 1, 30), ("a", t, t, 1, 30)], "k string, ts timestamp, f timestamp, i bigint, v bigint")
    assert [(r.k, r.v) for r in latest(df, ["k", "ts"], ["f", "i"], ["v"]).collect()] == [("a", None)]
