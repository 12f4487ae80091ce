import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, market, portfolio
from tickloom.operators.scan import day, scan

T0 = datetime(2024, 1, 1)


def test_scan_carries_over_slots(spark):
    rng = random.Random(2)
    rows = [(k, T0 + timedelta(hours=5 * i), rng.choice([None, rng.random()])) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = scan(df, ["k"], ["ts"], day("ts"), last={"l": F.col("v")}, total={"t": F.col("v")}, greatest={"g": F.col("v")}).collect()
    back = {(r.k, r.ts): r.l for r in scan(df, ["k"], ["ts"], day("ts"), last={"l": F.col("v")}, before=True).collect()}
    assert len(got) == 180
    for r in got:
        upto = [v for k, t, v in rows if k == r.k and t <= r.ts and v is not None]
        earlier = [v for k, t, v in rows if k == r.k and t < r.ts and v is not None]
        assert (r.l, r.g) == ((upto[-1], max(upto)) if upto else (None, None))
        assert r.t == (pytest.approx(sum(upto)) if upto else None)
        assert back[r.k, r.ts] == (earlier[-1] if earlier else None)


def test_resample(spark):
    df = spark.createDataFrame([(T0 + timedelta(hours=k), float(k), k + 2.0, k - 1.0, k + 1.0, 10.0) for k in range(24)], "ts timestamp, open double, high double, low double, close double, volume double")
    assert [tuple(r) for r in market.resample_ohlc(df, "1 day").collect()] == [(T0, 0.0, 25.0, -1.0, 24.0, 240.0)]
    starts = lambda w: market.resample_ohlc(df.withColumn("ts", F.lit("2024-01-03 05:00:00").cast("timestamp")), w).first().ts
    assert starts("1 week") == datetime(2024, 1, 1) and starts("1 quarter") == datetime(2024, 1, 1) and starts("2 years") == datetime(2024, 1, 1) and starts("15 minutes") == datetime(2024, 1, 3, 5)
    with pytest.raises(ValueError):
        starts("a while")
    assert market.resample_ohlc(df.limit(0), "1 day").count() == 0


def test_with_returns(spark):
    df = spark.createDataFrame([(T0 + timedelta(days=k), p) for k, p in enumerate((100.0, 101.0, None, 0.0, 5.0))], "ts timestamp, price double")
    got = [(r.simple_return, r.log_return) for r in market.with_returns(df).orderBy("ts").collect()]
    assert got[1] == (pytest.approx(0.01), pytest.approx(math.log(1.01)))
    assert got[0] == got[2] == got[3] == got[4] == (None, None)


def test_asof_join(spark):
    left = spark.createDataFrame([("a", T0 + timedelta(days=d), d) for d in (0, 1, 40)] + [("b", T0, 9), (None, T0, 8), ("a", None, 7)], "k string, t timestamp, x int")
    right = spark.createDataFrame([("a", T0 + timedelta(days=1), 1), ("a", T0 + timedelta(days=1), 2), ("a", T0 + timedelta(days=50), 3), (None, T0, 4)], "k string, t timestamp, x int")
    got = {(r.k, r.x): r.x_r for r in market.asof_join(left, right, "t", ["k"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 2, ("a", 40): 2, ("b", 9): None, (None, 8): None, ("a", 7): None}


def simulate(rows, capital, commission, slippage):
    cash, held, out, trades, start = capital, 0.0, [], [], None
    for i, (price, signal) in enumerate(rows):
        if signal == "BUY" and not held:
            fill = price * (1 + slippage)
            held, start, cash = cash / (1 + commission) / fill, (i, fill, cash), 0.0
        elif signal == "SELL" and held:
            got = held * price * (1 - slippage) * (1 - commission)
            trades.append((start[1], price * (1 - slippage), got - start[2], i - start[0]))
            cash, held = got, 0.0
        out.append((held, cash, cash + held * price))
    return out, trades


def test_backtest_against_a_simulation(spark):
    rng, price, rows = random.Random(11), 50.0, []
    for _ in range(200):
        price *= math.exp(rng.gauss(0, 0.02))
        rows.append((price, rng.choice(["BUY", "SELL", "HOLD", None, "buy "])))
    want, trades = simulate([(p, (s or "").strip().upper()) for p, s in rows], 1000.0, 0.01, 0.002)
    df = spark.createDataFrame([("s", T0 + timedelta(hours=9 * k), p, s) for k, (p, s) in enumerate(rows)] + [("s", None, 5.0, "BUY"), ("s", T0, None, "SELL")], "k string, ts timestamp, price double, signal string")
    got = backtest.backtest_equity(df, 1000.0, 0.01, 0.002, ["k"]).orderBy("ts").collect()
    assert [(r.position, r.cash, r.equity) for r in got] == [pytest.approx(w) for w in want]
    closed = backtest.backtest_trades(df.drop("k"), 1000.0, 0.01, 0.002).orderBy("entry_ts").collect()
    assert [(r.entry_price, r.exit_price, r.pnl, r.bars_held) for r in closed] == [pytest.approx(t) for t in trades]
    stats = {r.metric: r.value for r in backtest.backtest_stats(df, 1000.0, 0.01, 0.002, ["k"]).collect()}
    assert tuple(stats) == backtest.METRICS and stats["final_equity"] == pytest.approx(want[-1][2]) and stats["num_trades"] == len(trades) and stats["num_bars"] == 200
    assert backtest.backtest_stats(df.limit(0), 1.0).count() == 0
    with pytest.raises(ValueError):
        backtest.backtest_equity(df, 0)


def test_portfolios(spark):
    rng = random.Random(5)
    data = [(T0 + timedelta(days=d), s, rng.gauss(0.001 * k, 0.01 * k)) for d in range(60) for k, s in enumerate(("a", "b", "c"), 1)]
    df = spark.createDataFrame(data, "ts timestamp, symbol string, return double")
    least = portfolio.min_variance_portfolio(df).collect()
    best = portfolio.max_sharpe_portfolio(df, 0.0001).collect()
    assert sum(r.weight for r in least) == pytest.approx(1) and sum(r.weight for r in best) == pytest.approx(1)
    front = portfolio.efficient_frontier(df, 5).collect()
    assert len(front) == 15 and min(r.volatility for r in front) >= least[0].volatility - 1e-9
    with pytest.raises(ValueError):
        portfolio.min_variance_portfolio(df.where("symbol = 'a'"))
    with pytest.raises(ValueError):
        portfolio.min_variance_portfolio(df.where("symbol <> 'a' or ts > '2024-01-05'"))
    with pytest.raises(ValueError):
        portfolio.efficient_frontier(df, 1)


def test_monte_carlo(spark):
    paths = portfolio.monte_carlo(spark, 100.0, 0.05, 0.2, 10, 500, seed=3)
    assert paths.count() == 5500 and paths.where("day = 0 and price = 100").count() == 500
    again = portfolio.monte_carlo(spark, 100.0, 0.05, 0.2, 10, 500, seed=3).repartition(7)
    total = lambda df: df.agg(F.round(F.sum("price"), 6)).first()[0]
    assert total(paths) == total(again) != total(portfolio.monte_carlo(spark, 100.0, 0.05, 0.2, 10, 500, seed=4))
    assert portfolio.monte_carlo(spark, 100.0, 0.0, 0.0, 3, 2).where("price <> 100").count() == 0
    for bad in ((0, 0, 1, 1, 1), (1, 0, -1, 1, 1), (1, 0, 1, 0, 1), (1, 0, 1, 1, 0)):
        with pytest.raises(ValueError):
            portfolio.monte_carlo(spark, *bad)
