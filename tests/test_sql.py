import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import oscillators, returns, trend
from tickloom.sql import AGGREGATES, rewrite, sql

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    df = spark.createDataFrame([(s, T0 + timedelta(days=k), 10.0 + k + (k % 3), 12.0 + k, 9.0 + k, 100.0 + k, (-1) ** k * 0.01 * k, "BUY" if k == 3 else "SELL" if k == 20 else "HOLD") for s in ("a", "b") for k in range(70)], "symbol string, ts timestamp, close double, high double, low double, volume double, ret double, signal string")
    df.createOrReplaceTempView("bars")
    return df


def test_aggregates_by_name(spark, bars):
    got = sql(spark, "SELECT symbol, ema(close, ts, 5) AS e, RSI(close, ts) AS r, sharpe_ratio(ret, 0.001) AS s, round(adx(high, low, close, ts, 10), 3) AS x, value_at_risk(ret, 0.9) AS v -- ema(x)\nFROM bars GROUP BY symbol ORDER BY 1").collect()
    want = bars.groupBy("symbol").agg(trend.ema("close", "ts", 5).alias("e"), oscillators.rsi("close", "ts").alias("r"), returns.sharpe_ratio("ret", 0.001).alias("s"), F.round(trend.adx("high", "low", "close", "ts", 10), 3).alias("x"), returns.value_at_risk("ret", 0.9).alias("v")).orderBy("symbol").collect()
    assert [tuple(r)[1:] for r in got] == [pytest.approx(tuple(r)[1:]) for r in want]


def test_windows_filters_and_nesting(spark, bars):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-9, 0)
    got = sql(spark, "SELECT symbol, ts, ema(close, ts, 5) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS e FROM bars ORDER BY 1, 2").collect()
    want = bars.select("symbol", "ts", trend.ema("close", "ts", 5, over=w).alias("e")).orderBy("symbol", "ts").collect()
    assert [r.e for r in got] == pytest.approx([r.e for r in want])
    row = sql(spark, "SELECT first_s(close, ts) FILTER (WHERE close > 20) AS f, vwap(greatest(close, 20), volume) AS v, 'ema(1)' AS t FROM bars").first()
    assert row.f == bars.where("close > 20").agg(returns.first_s("close", "ts")).first()[0] and row.t == "ema(1)"
    named = sql(spark, "SELECT sma(close) OVER w AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING)")
    assert named.count() == 140


def test_every_aggregate_has_sql(spark, bars):
    columns = {"a": "ret", "b": "ret", "asset": "close", "bench": "high", "open_": "close", "price": "close", "value": "close", "x": "close"}
    import inspect

    for name, builder in AGGREGATES.items():
        needed = [columns.get(p.name, p.name) for p in inspect.signature(builder).parameters.values() if p.default is p.empty]
        arguments = ", ".join("5" if a == "period" else a for a in needed)
        assert sql(spark, f"SELECT symbol, {name}({arguments}) AS x FROM bars GROUP BY symbol").count() == 2, name


def test_table_functions(spark, bars):
    assert sql(spark, "SELECT count(*) FROM monte_carlo(100, 0.05, 0.2, 10, 5, 7)").first()[0] == 55
    stats = sql(spark, "SELECT metric, value FROM backtest_stats('SELECT ts, close AS price, signal FROM bars WHERE symbol = ''a''', 1000, 0.001) WHERE metric = 'num_trades'").first()
    assert stats.value == 1
    assert sql(spark, "SELECT sum(weight) FROM min_variance_portfolio('SELECT ts, symbol, ret * CASE symbol WHEN ''a'' THEN 1 ELSE cos(close) END FROM bars')").first()[0] == pytest.approx(1)
    assert sql(spark, "SELECT * FROM resample_ohlc('SELECT ts, close AS open, high, low, close, volume FROM bars', INTERVAL 1 WEEK)").count() == 10


def test_errors(spark, bars):
    with pytest.raises(ValueError, match="constant"):
        rewrite(spark, "SELECT ema(close, ts, volume) FROM bars")
    with pytest.raises(ValueError, match="at most"):
        rewrite(spark, "SELECT obv(close, volume, ts, 1) FROM bars")


def test_arguments_by_name(spark, bars):
    got = sql(spark, "SELECT round(ema(close, ts, period := 5), 9) AS a, round(ema(value := close, ts => ts, period := 5), 9) AS b FROM bars WHERE symbol = 'a'").first()
    assert got.a == got.b == pytest.approx(bars.where("symbol = 'a'").agg(trend.ema("close", "ts", 5)).first()[0])
    from tickloom.sources.samples import SAMPLES

    options, answers = SAMPLES["read_eth"]
    recorded = json.dumps(answers).replace("'", "''")
    named = f"strict := true, symbols := '{options['symbols']}', blocks_per_thread := 5, responses := '{recorded}'"
    rows = sql(spark, f"SELECT event_type FROM read_eth('coin', '', 100, 109, {named})").collect()
    assert sorted(r[0] for r in rows) == ["Sync", "Transfer", "Unknown"]
    for wrong in ("read_eth('coin', '', 100, 109, strict := true, strict := false)", "read_eth('coin', '', 100, 109, sym := 'x')", "read_eth('coin', to_block := 1, 'Transfer')", "read_eth('coin', address := 'x')"):
        with pytest.raises(ValueError):
            sql(spark, f"SELECT * FROM {wrong}")
    with pytest.raises(ValueError):
        rewrite(spark, "SELECT ema(close, ts, value := close) FROM bars")
