"""Fixtures with known results, random series against plain Python, and edge cases."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import oscillators as osc
from tickloom.functions import returns as ret
from tickloom.functions import stats, trend

from test_known_values import CLOSES

T0 = datetime(2024, 1, 1)


def frame(spark, columns, rows):
    types = ", ".join(f"{c} double" for c in columns.split())
    return spark.createDataFrame([(T0 + timedelta(days=k), *map(lambda x: None if x is None else float(x), r)) for k, r in enumerate(rows)], f"ts timestamp, {types}")


def one(df, **columns):
    return df.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict()


PRICES = [(p,) for p in (100, 101, 103, 102, 104, 106, 105, 107, 108, 109)]
RSI = [(p,) for p in CLOSES]


def ema(values, period):
    k, e = 2 / (period + 1), values[0]
    for v in values[1:]:
        e = v * k + e * (1 - k)
    return e


def test_moving_averages(spark):
    df = frame(spark, "v", PRICES)
    values = [p for (p,) in PRICES]
    got = one(df, e3=trend.ema("v", "ts", 3), e0=trend.ema("v", "ts", 0), w=trend.wma("v", "ts", 3), m=trend.macd_line("v", "ts", 3, 5), mid=trend.bollinger_middle("v", "ts", 5), d=trend.dema("v", "ts", 0), width=trend.bollinger_width("v", "ts", 5, 2.0), up=trend.bollinger_upper("v", "ts", 5), low=trend.bollinger_lower("v", "ts", 5))
    assert got["e3"] == pytest.approx(ema(values, 3))
    assert got["e0"] == 109
    assert got["w"] == pytest.approx((107 + 2 * 108 + 3 * 109) / 6)
    assert got["m"] == pytest.approx(ema(values, 3) - ema(values, 5))
    assert got["mid"] == pytest.approx(sum(values[-5:]) / 5)
    assert got["d"] is None
    assert got["width"] == pytest.approx((got["up"] - got["low"]) / got["mid"])


def test_double_and_triple(spark):
    values = [random.Random(1).uniform(1, 9) for _ in range(30)]
    e1, e2, e3 = [], [], []
    for n in range(1, 31):
        e1.append(ema(values[:n], 5))
        e2.append(ema(e1, 5))
        e3.append(ema(e2, 5))
    got = one(frame(spark, "v", [(v,) for v in values]), d=trend.dema("v", "ts", 5), t=trend.tema("v", "ts", 5))
    assert got["d"] == pytest.approx(2 * e1[-1] - e2[-1])
    assert got["t"] == pytest.approx(3 * e1[-1] - 3 * e2[-1] + e3[-1])


def test_rsi_and_ranges(spark):
    got = one(frame(spark, "v", RSI), a=osc.rsi("v", "ts", 14), few=osc.rsi("v", "ts", 20), up=osc.rsi("v", "ts", 19))
    assert got["few"] is None and 0 < got["a"] < 100 and got["up"] is not None
    rising = one(frame(spark, "v", [(k,) for k in range(20)]), r=osc.rsi("v", "ts", 14))
    assert rising["r"] == 100
    bars = frame(spark, "h l c", [(10 + k, 8 + k, 9 + k) for k in range(40)])
    got = one(bars, atr=osc.atr("h", "l", "c", "ts", 3), k=osc.stochastic_k("c", "h", "l", "ts", 3), w=osc.williams_r("h", "l", "c", "ts", 3), adx=trend.adx("h", "l", "c", "ts"), p=trend.plus_di("h", "l", "c", "ts"), m=trend.minus_di("h", "l", "c", "ts"), t=trend.ichimoku_tenkan("h", "l", "ts"))
    assert got["atr"] == 2 and got["k"] == 75 and got["w"] == -25 and got["adx"] == pytest.approx(100) and got["p"] == pytest.approx(50) and got["m"] == 0
    assert got["t"] == (49 + 39) / 2
    assert one(bars.limit(0), a=osc.atr("h", "l", "c", "ts"))["a"] is None
    flat = frame(spark, "h l c", [(5, 5, 5)] * 3)
    assert one(flat, k=osc.stochastic_k("c", "h", "l", "ts"), w=osc.williams_r("h", "l", "c", "ts")) == {"k": 50, "w": None}


def test_volume(spark):
    df = frame(spark, "h l c v", [(10, 8, 10, 100), (11, 9, 9, 200), (12, 10, 12, 300)])
    got = one(df, obv=osc.obv("c", "v", "ts"), ad=osc.ad_line("h", "l", "c", "v", "ts"), cmf=osc.cmf("h", "l", "c", "v", "ts"), vwap=osc.vwap("c", "v"), mfi=osc.mfi("h", "l", "c", "v", "ts", 14))
    assert got["obv"] == 100 and got["ad"] == 200 and got["cmf"] == pytest.approx(200 / 600) and got["vwap"] == pytest.approx((1000 + 1800 + 3600) / 600) and got["mfi"] == 100
    assert one(frame(spark, "c v", [(1, 0)]), x=osc.vwap("c", "v"))["x"] is None


def test_heikin_ashi(spark):
    rows = [(1, 3, 0, 2), (2, 5, 1, 4), (4, 6, 3, 5)]
    o = (1 + 2) / 2
    for k in range(1, 3):
        o = (o + sum(rows[k - 1]) / 4) / 2
    got = one(frame(spark, "o h l c", rows), o=osc.ha_open("o", "h", "l", "c", "ts"), h=osc.ha_high("o", "h", "l", "c", "ts"), l=osc.ha_low("o", "h", "l", "c", "ts"), c=osc.ha_close("o", "h", "l", "c", "ts"))
    assert got == {"o": pytest.approx(o), "h": 6, "l": pytest.approx(min(o, 3)), "c": 4.5}


def test_nulls_are_skipped(spark):
    df = frame(spark, "v", [(100,), (None,), (102,)])
    assert one(df, e=trend.ema("v", "ts", 2))["e"] == pytest.approx(102 * 2 / 3 + 100 / 3)
    empty = one(df.where("false"), e=trend.ema("v", "ts", 2), r=ret.cumulative_return("v", "ts"), d=ret.drawdown_duration("v", "ts"), h=stats.hurst_exponent("v", "ts"))
    assert set(empty.values()) == {None}


def test_risk(spark):
    df = frame(spark, "r b", [(0.01, 0.02), (-0.02, -0.04), (0.03, 0.06), (0.0, 0.0), (0.01, 0.02)])
    r = [0.01, -0.02, 0.03, 0.0, 0.01]
    mean, sd = sum(r) / 5, math.sqrt(sum((x - sum(r) / 5) ** 2 for x in r) / 5)
    got = one(df, s=ret.sharpe_ratio("r", 0.005), so=ret.sortino_ratio("r", 0.0), c=ret.portfolio_correlation("r", "b"), beta=ret.portfolio_beta("b", "r"), w=ret.win_rate("r"), pf=ret.profit_factor("r"), e=ret.expectancy("r"), v=ret.value_at_risk("r", 0.95), ir=ret.information_ratio("r", "r"), wl=ret.avg_win_loss_ratio("r"), av=ret.annualized_volatility("r"))
    assert got["s"] == pytest.approx((mean - 0.005) / sd)
    assert got["so"] == pytest.approx(mean / math.sqrt(0.0004 / 5))
    assert got["c"] == pytest.approx(1) and got["beta"] == pytest.approx(2) and got["w"] == pytest.approx(0.6)
    assert got["pf"] == pytest.approx(2.5) and got["e"] == pytest.approx(0.03 / 4) and got["v"] == pytest.approx(0.016)
    assert got["ir"] == 0 and got["wl"] == pytest.approx((0.05 / 3) / 0.02) and got["av"] == pytest.approx(sd * math.sqrt(252))
    flat = one(frame(spark, "r b", [(1, 2), (1, 3)]), c=ret.portfolio_correlation("r", "b"), s=ret.sharpe_ratio("r"), beta=ret.portfolio_beta("b", "r"), pf=ret.profit_factor("r"))
    assert flat == {"c": 0, "s": None, "beta": None, "pf": math.inf}


def test_drawdowns(spark):
    df = frame(spark, "v", [(100,), (120,), (80,), (90,), (120,), (60,)])
    got = one(df, m=ret.max_drawdown("v", "ts"), d=ret.drawdown_duration("v", "ts"), c=ret.cumulative_return("v", "ts"), mo=ret.momentum_score("v", "ts", 2), rs=ret.relative_strength("v", "v", "ts"))
    assert got["m"] == pytest.approx(-0.5) and got["d"] == 4 and got["c"] == pytest.approx(-0.4) and got["mo"] == pytest.approx(-1 / 3) and got["rs"] == 1
    assert one(df.limit(1), m=ret.max_drawdown("v", "ts"))["m"] is None
    rising = frame(spark, "r v", [(0.1, 1), (0.1, 2)])
    assert one(rising, c=ret.calmar_ratio("r", "v", "ts"))["c"] == math.inf


def test_statistics(spark):
    noise = random.Random(5)
    trend_up = one(frame(spark, "v", [(k,) for k in range(512)]), h=stats.hurst_exponent("v", "ts"))
    white = one(frame(spark, "v", [(noise.gauss(0, 1),) for _ in range(512)]), h=stats.hurst_exponent("v", "ts"), a=stats.adf_test_stat("v", "ts"))
    assert trend_up["h"] > 0.9 and 0.4 < white["h"] < 0.75 and white["a"] < -10
    short = one(frame(spark, "v", [(noise.gauss(0, 1),) for _ in range(63)]), h=stats.hurst_exponent("v", "ts"))
    flat = one(frame(spark, "v", [(1,)] * 70), h=stats.hurst_exponent("v", "ts"), a=stats.adf_test_stat("v", "ts"))
    assert short["h"] is None and set(flat.values()) == {None}


def test_first_and_last(spark):
    df = spark.createDataFrame([(None, T0), (5, None), (7, T0 + timedelta(1)), (9, T0 + timedelta(2)), (None, T0 + timedelta(3))], "v int, ts timestamp")
    assert one(df, f=ret.first_s("v", "ts"), l=ret.last_s("v", "ts")) == {"f": 7, "l": 9}


def test_windows_agree_with_groups(spark):
    rows = [(random.Random(9).uniform(1, 9) + k, 0.5, 0.7, 3) for k in range(30)]
    df = frame(spark, "h l c v", rows)
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    for f in (lambda o: osc.rsi("h", "ts", 5, over=o), lambda o: trend.ema("h", "ts", 4, over=o), lambda o: osc.atr("h", "l", "c", "ts", 3, over=o), lambda o: ret.max_drawdown("h", "ts", over=o), lambda o: osc.obv("h", "v", "ts", over=o), lambda o: ret.value_at_risk("h", over=o)):
        last = df.select("ts", f(w).alias("x")).orderBy(F.desc("ts")).first()["x"]
        assert last == pytest.approx(one(df, x=f(None))["x"])
