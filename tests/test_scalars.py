import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.functions import pricing, scalars
from tickloom.registry import register


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def lit(*values):
    return [F.lit(v) for v in values]


def test_signals(spark):
    v = lambda c: value(spark, c)
    assert v(scalars.ma_crossover_signal(2.0, 1.0)) == "BUY"
    assert v(scalars.rsi_signal(70.0)) == "SELL" and v(scalars.rsi_signal(30.0)) == "BUY" and v(scalars.rsi_signal(50.0)) == "HOLD"
    assert v(scalars.rsi_signal(75.0, 80.0, 20.0)) == "HOLD"
    assert v(scalars.bollinger_signal(5.0, 4.0, 1.0)) == "SELL"
    assert v(scalars.kelly_fraction(0.6, 2.0, 1.0)) == pytest.approx(0.4)
    assert v(scalars.kelly_fraction(0.6, 1.0, 0.0)) == 0 and v(scalars.kelly_fraction(1.0, 0.0, 1.0)) == 1 and v(scalars.kelly_fraction(0.5, 0.0, 1.0)) == 0
    assert v(scalars.composite_score(0.0, 9.0, 0.0, 1.0)) == 100
    assert v(scalars.composite_score(F.lit(None), 9.0, 0.0, 1.0)) is None


def test_returns_and_helpers(spark):
    v = lambda c: value(spark, c)
    assert v(scalars.simple_return(1.0, 0.0)) == 0 and v(scalars.pct_change(1.0, 0.0)) is None
    assert v(scalars.log_return(-1.0, 1.0)) == 0 and v(scalars.log_return(F.lit(None), 1.0)) is None
    assert v(scalars.clip(5.0, 0.0, F.lit(None))) == 5 and v(scalars.clip(9.0, 0.0, 2.0)) == 2
    assert v(scalars.safe_div(1.0, 0.0)) is None and v(scalars.zscore(3.0, 1.0, 2.0)) == 1
    assert v(scalars.pct_to_bps(0.01)) == 100 and v(scalars.bps_to_pct(100.0)) == 0.01
    assert v(scalars.pivot_point(3.0, 1.0, 2.0)) == 2 and v(scalars.pivot_r3(3.0, 1.0, 2.0)) == 5 and v(scalars.pivot_s3(3.0, 1.0, 2.0)) == -1


def test_timebucket(spark):
    v = lambda t: value(spark, scalars.timebucket(F.lit(t).cast("timestamp"), 5_000_000))
    assert v("2024-01-01 00:00:07") == datetime(2024, 1, 1, 0, 0, 5)
    assert v("1969-12-31 23:59:58") == datetime(1970, 1, 1)
    assert value(spark, scalars.timebucket(F.lit(None).cast("timestamp"), 5_000_000)) is None


def test_candles(spark):
    v = lambda c: value(spark, c)
    assert v(scalars.is_doji(1.0, 1.0, 1.0, 1.0)) and v(scalars.is_doji(1.0, 2.0, 0.0, 1.01)) and not v(scalars.is_doji(1.0, 2.0, 0.0, 1.5))
    assert v(scalars.is_hammer(9.0, 10.0, 1.0, 10.0)) and v(scalars.is_shooting_star(2.0, 10.0, 1.0, 1.0))
    assert v(scalars.is_engulfing(1.0, 9.0, 0.0, 5.0, 4.0, 2.0)) == "BULLISH" and v(scalars.is_engulfing(5.0, 9.0, 0.0, 1.0, 2.0, 4.0)) == "BEARISH" and v(scalars.is_engulfing(1.0, 9.0, 0.0, 2.0, 4.0, 2.0)) is None
    assert v(scalars.is_morning_star(10.0, 5.0, 4.0, 4.5, 5.0, 9.0)) and v(scalars.is_evening_star(5.0, 10.0, 11.0, 10.5, 10.0, 6.0))
    assert v(scalars.is_hammer(F.lit(None), 10.0, 1.0, 10.0)) is None


def test_options(spark):
    v = lambda c: value(spark, c)
    a = (100.0, 95.0, 0.5, 0.03, 0.25)
    call, put = v(pricing.bs_call(*a)), v(pricing.bs_put(*a))
    assert call - put == pytest.approx(100 - 95 * math.exp(-0.015), abs=1e-6)
    assert v(pricing.bs_delta_call(*a)) - v(pricing.bs_delta_put(*a)) == pytest.approx(1)
    assert v(pricing.bs_implied_vol(call, *a[:4], F.lit(True))) == pytest.approx(0.25, abs=1e-6)
    assert v(pricing.bs_implied_vol(put, *a[:4], F.lit(False))) == pytest.approx(0.25, abs=1e-6)
    assert v(pricing.bs_call(0.0, *a[1:])) is None and v(pricing.bs_gamma(*a)) > 0 and v(pricing.bs_vega(*a)) > 0 and v(pricing.bs_theta_call(*a)) < 0
    assert v(pricing.am_put(*a)) >= put and v(pricing.am_call(*a)) == pytest.approx(call, abs=0.02) and v(pricing.am_put(*a, steps=0)) is None


def test_bonds(spark):
    v = lambda c: value(spark, c)
    assert v(pricing.bond_price(1000.0, 0.05, 0.05, F.lit(10), 2.0)) == pytest.approx(1000)
    assert v(pricing.bond_ytm(950.0, 1000.0, 0.05, F.lit(10), 2.0)) > 0.05
    assert v(pricing.bond_price(1000.0, 0.05, 0.0, F.lit(10), 2.0)) == pytest.approx(1250)
    assert v(pricing.bond_price(1000.0, 0.05, 0.05, F.lit(0), 2.0)) is None
    mac, mod = v(pricing.bond_macaulay_duration(1000.0, 0.05, 0.05, F.lit(10), 2.0)), v(pricing.bond_modified_duration(1000.0, 0.05, 0.05, F.lit(10), 2.0))
    assert mod == pytest.approx(mac / 1.025) and v(pricing.bond_convexity(1000.0, 0.05, 0.05, F.lit(10), 2.0)) > 0


def test_sql_names_agree_with_columns(spark):
    register(spark)
    register(spark)
    row = spark.sql("SELECT bs_put(100, 95, 0.5, 0.03, 0.25) a, rsi_signal(75, 80, 20) b, bond_convexity(1000, 0.05, 0.05, 10, 2) c, is_doji(1, 2, 0, 1.01) d, timebucket(timestamp'2024-01-01 00:00:07', interval 5 second) e, bs_call(-1, 95, 0.5, 0.03, 0.25) f").first()
    assert row.a == pytest.approx(value(spark, pricing.bs_put(100.0, 95.0, 0.5, 0.03, 0.25))) and row.b == "HOLD" and row.d
    assert row.c == pytest.approx(value(spark, pricing.bond_convexity(1000.0, 0.05, 0.05, F.lit(10), 2.0)))
    assert row.e == datetime(2024, 1, 1, 0, 0, 5) and row.f is None
