"""Queries written in SQL with the library's names, over the bars as a view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import indicators, tables
from tickloom.plans.views import bars
from tickloom.sql import sql

_STATEMENTS: dict[str, str] = {
    "sql_rsi": "SELECT symbol, round(rsi(close, ts), 6) AS rsi FROM {bars} GROUP BY symbol",
    "sql_keltner_upper": "SELECT symbol, round(keltner_upper(high, low, close, ts, multiplier := 2.0), 6) AS keltner_upper FROM {bars} GROUP BY symbol",
    "sql_ema_window": "SELECT symbol, unix_micros(ts) AS bar_us, round(ema(close, ts, 20) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS ema_window FROM {bars}",
    "sql_resample_ohlc": "SELECT unix_micros(ts) AS ts_us, open, high, low, close, volume FROM resample_ohlc('SELECT * FROM {bars} WHERE symbol = ''purchase''', INTERVAL 1 WEEK)",
    "sql_backtest_stats": "SELECT metric, round(value, 4) AS value FROM backtest_stats('SELECT * FROM {signals}', {capital}, commission := {commission}, slippage := {slippage})",
}


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        views = {"bars": f"_{name}_bars", "signals": f"_{name}_signals"}
        bars(spark, sf).createOrReplaceTempView(views["bars"])
        tables.signals(spark, sf).createOrReplaceTempView(views["signals"])
        return sql(spark, _STATEMENTS[name].format(**views, capital=tables.CAPITAL, commission=tables.COMMISSION, slippage=tables.SLIPPAGE))

    return query


QUERIES = {name: _statement(name) for name in _STATEMENTS}
ORACLE = {
    **{f"sql_{name}": indicators.ORACLE[name] for name in ("rsi", "keltner_upper", "ema_window")},
    "sql_resample_ohlc": f"SELECT ts_us, open, high, low, close, volume FROM ({tables.ORACLE['resample_ohlc']}) AS w WHERE symbol = 'purchase'",
    "sql_backtest_stats": tables.ORACLE["backtest_stats"],
}
