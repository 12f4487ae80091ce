"""Closed forms against the folds, over many days, thin days, ties and few rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window

from tickloom.functions import closed, stats, trend
from tickloom.functions import oscillators as osc
from tickloom.functions import returns as ret

T0 = datetime(2024, 1, 1)
HLC = ("high", "low", "close", "ts")


@pytest.mark.parametrize("n", [1, 2, 5, 15, 200])
def test_closed_forms_equal_folds(spark, n):
    rng = random.Random(n)
    rows = [(k, T0 + timedelta(hours=11 * i), c - 1, c + rng.random(), c - rng.random(), c, float(rng.randrange(9))) for k in ("a", None) for i in range(n) for c in [100 + rng.gauss(0, 5)]]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", T0, None, 1.0, 1.0, 1.0, 1.0)], "k string, ts timestamp, open double, high double, low double, close double, volume double").withColumnRenamed("k", "key")
    fields = ["open", "high", "low", "close", "volume"]
    full = df.dropna(subset=["ts", *fields])
    pairs = {
        "ema": (closed.ema("close", 7), trend.ema("close", "ts", 7)),
        "dema": (closed.dema("close", 7), trend.dema("close", "ts", 7)),
        "tema": (closed.tema("close", 7), trend.tema("close", "ts", 7)),
        "wma": (closed.wma("close", 20), trend.wma("close", "ts", 20)),
        "macd": (closed.macd_line("close"), trend.macd_line("close", "ts")),
        "upper": (closed.bollinger("close")["upper"], trend.bollinger_upper("close", "ts")),
        "keltner": (closed.keltner()["lower"], trend.keltner_lower(*HLC)),
        "kijun": (closed.midpoint(26), trend.ichimoku_kijun("high", "low", "ts")),
        "atr": (closed.atr(), osc.atr(*HLC)),
        "rsi": (closed.rsi("close"), osc.rsi("close", "ts")),
        "k": (closed.stochastic_k(), osc.stochastic_k("close", "high", "low", "ts")),
        "w": (closed.williams_r(), osc.williams_r(*HLC)),
        "obv": (closed.obv(), osc.obv("close", "volume", "ts")),
        "ha": (closed.ha_open(), osc.ha_open("open", *HLC)),
        "hi": (closed.ha_high("open", *HLC[:3]), osc.ha_high("open", *HLC)),
        "lo": (closed.ha_low("open", *HLC[:3]), osc.ha_low("open", *HLC)),
        "mfi": (closed.mfi(), osc.mfi("high", "low", "close", "volume", "ts")),
        "cmf": (closed.cmf(), osc.cmf("high", "low", "close", "volume", "ts")),
        "adx": (closed.adx(period=5), trend.adx(*HLC, 5)),
        "plus": (closed.plus_di(period=2), trend.plus_di(*HLC, 2)),
        "minus": (closed.minus_di(period=2), trend.minus_di(*HLC, 2)),
        "momentum": (closed.momentum_score("close", "ts", 10), ret.momentum_score("close", "ts", 10)),
        "adf": (closed.adf_test_stat("close"), stats.adf_test_stat("close", "ts")),
        "ad": (closed.ad_line(), osc.ad_line("high", "low", "close", "volume", "ts")),
    }
    placed = closed.prepare(df, ["key"], "ts", fields)
    a = {r.key: r for r in placed.groupBy("key").agg(*[c.alias(m) for m, (c, _) in pairs.items()]).collect()}
    b = {r.key: r for r in full.groupBy("key").agg(*[c.alias(m) for m, (_, c) in pairs.items()]).collect()}
    assert a.keys() == b.keys()
    for key in a:
        for m in pairs:
            assert a[key][m] == (None if b[key][m] is None else pytest.approx(b[key][m], abs=1e-9)), (key, m)


@pytest.mark.parametrize("n", [1, 2, 7, 63, 64, 700])
def test_drawdowns_and_exponents_equal_folds(spark, n):
    rng = random.Random(n)
    rows = [(k, T0 + timedelta(hours=17 * i), None if k == "nulls" and i % 3 == 0 else v, rng.gauss(0, 1)) for k in ("walk", "ties", "rise", "flat", None, "nulls") for i in range(n) for v in [100 + rng.gauss(0, 5) if k != "ties" else float(rng.randrange(3)), ]]
    rows = [(k, t, (t - T0).total_seconds() if k == "rise" else 5.0 if k == "flat" else v, r) for k, t, v, r in rows]
    df = spark.createDataFrame(rows, "key string, ts timestamp, close double, r double")
    full = df.dropna(subset=["close"])
    want = {x.key: x for x in full.groupBy("key").agg(ret.max_drawdown("close", "ts").alias("d"), ret.drawdown_duration("close", "ts").alias("t"), ret.calmar_ratio("r", "close", "ts").alias("c"), stats.hurst_exponent("close", "ts").alias("h")).collect()}
    got = {x.key: x for x in closed.drawdowns(df, ["key"], "ts", "close").collect()}
    calmar = {x.key: x.calmar_ratio for x in closed.calmar(df, ["key"], "ts", "r", "close").collect()}
    hurst = {x.key: x.hurst_exponent for x in closed.hurst(df, ["key"], "ts", "close").collect()}
    near = lambda x: None if x is None else pytest.approx(x, abs=1e-9)
    assert got.keys() == calmar.keys() == hurst.keys() == want.keys()
    for k, w in want.items():
        assert (got[k].max_drawdown, got[k].drawdown_duration, calmar[k], hurst[k]) == (near(w.d), w.t, near(w.c), near(w.h)), k


def test_frames_as_lags_equal_folds(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, T0 + timedelta(days=i), 5.0 if k == "flat" else rng.gauss(50, 3)) for k in ("a", "b", "flat") for i in range(40)], "key string, ts timestamp, v double")
    w = Window.partitionBy("key").orderBy("ts")
    rows = df.select(trend.ema_rows("v", 8, w, 12).alias("e"), trend.ema("v", "ts", 8, over=w.rowsBetween(-11, 0)).alias("e2"), osc.rsi_rows("v", 9, w).alias("r"), osc.rsi("v", "ts", 9, over=w.rowsBetween(-9, 0)).alias("r2")).collect()
    assert all(x.e == pytest.approx(x.e2) and x.r == (None if x.r2 is None else pytest.approx(x.r2)) for x in rows) and any(x.r is None for x in rows)


def test_far_back_is_forgotten(spark):
    rng = random.Random(8)
    rows = [(T0 + timedelta(hours=i), c + rng.random(), c - rng.random(), c) for i in range(2000) for c in [100 + 0.01 * i + rng.gauss(0, 5)]]
    df = spark.createDataFrame(rows, "ts timestamp, high double, low double, close double")
    placed = closed.prepare(df, [], "ts", ["high", "low", "close"])
    a = placed.agg(closed.adx().alias("x"), closed.plus_di().alias("p"), closed.minus_di().alias("m")).first()
    b = df.agg(trend.adx(*HLC).alias("x"), trend.plus_di(*HLC).alias("p"), trend.minus_di(*HLC).alias("m")).first()
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-13)


def test_without_keys_and_empty(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=k), float(k)) for k in range(5)], "ts timestamp, v double")
    assert closed.prepare(df, [], "ts", ["v"]).agg(closed.ema("v", 1)).first()[0] == 4
    assert closed.prepare(df.limit(0), [], "ts", ["v"]).agg(closed.ema("v", 1)).first()[0] is None
