"""Backtests of BUY, SELL and HOLD signals: long or flat, with all the capital.

A BUY while long and a SELL while flat change nothing, so the position after each row is that of
the last signal other than HOLD, and the equity is the capital times a product of factors. Both
are running values, no row-wise simulation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scan import day, scan
from tickloom.session import materialize

#: Statistics in their order.
METRICS = ("initial_capital", "final_equity", "total_return", "num_bars", "num_trades", "cagr", "annualized_volatility", "sharpe_ratio", "max_drawdown", "win_rate", "profit_factor")


def _simulate(df: DataFrame, capital: float, commission: float, slippage: float, keys: Sequence[str]) -> DataFrame:
    if capital <= 0 or commission < 0 or slippage < 0:
        raise ValueError("capital must be above 0, costs must not be below 0")
    signal = F.upper(F.trim("signal"))
    rows = df.where(F.col("ts").isNotNull() & F.col("price").isNotNull()).select(*keys, "ts", F.col("price").cast("double").alias("price"), F.when(signal == "BUY", 1).when(signal == "SELL", 0).alias("turn"))
    # all that a row needs of those before it comes from one scan: the last signal, the price, and how many there are
    then = scan(rows, keys, ["ts", "price", "turn"], day("ts"), last={"signal": F.col("turn"), "price_before": F.col("price")}, total={"bars": F.lit(1)}, before=True)
    long, was = F.coalesce(F.col("turn"), F.col("signal"), F.lit(0)) == 1, F.coalesce(F.col("signal"), F.lit(0)) == 1
    kept = F.try_divide(F.col("price"), F.col("price_before"))
    factor = F.when(long & ~was, 1 / ((1 + commission) * (1 + slippage))).when(long, kept).when(was, kept * ((1 - slippage) * (1 - commission))).otherwise(1.0)
    moves = then.withColumns({"bar": F.coalesce("bars", F.lit(0)) + 1, "buys": (long & ~was).cast("int"), "sells": (was & ~long).cast("int"), "open": long, "factor": factor}).drop("turn", "signal", "price_before", "bars")
    rate = F.when(F.col("factor") > 0, F.ln("factor")).otherwise(F.lit(float("-inf")))
    run = scan(moves, keys, ["ts", "bar"], day("ts"), total={"growth": rate, "trade": F.col("buys")})
    return run.withColumn("equity", F.lit(float(capital)) * F.exp("growth")).drop("growth")


def backtest_equity(df: DataFrame, capital: float, commission: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, ts, price, position, cash, equity)`` per row with a time and a price.

    Signals fill at the row's price, worse by ``slippage``; ``commission`` is a share of the
    amount. Signals ignore case; null and others count as HOLD. Rows of equal time follow price,
    then signal (HOLD, SELL, BUY). Prices must not be below 0.
    """
    e = _simulate(df, capital, commission, slippage, keys)
    return e.select(*keys, "ts", "price", F.when(F.col("open"), F.try_divide("equity", "price")).otherwise(0.0).alias("position"), F.when(F.col("open"), 0.0).otherwise(F.col("equity")).alias("cash"), "equity")


def _trades(e: DataFrame, keys: Sequence[str], commission: float, slippage: float) -> DataFrame:
    buy, sell = F.col("buys") == 1, F.col("sells") == 1
    # the money spent at a BUY is the equity before its costs
    spent = F.col("equity") * ((1 + commission) * (1 + slippage))
    one = (
        e.where(buy | sell).groupBy(*keys, "trade")
        .agg(*[F.max(F.when(c, x)).alias(n) for n, c, x in (("entry_ts", buy, F.col("ts")), ("exit_ts", sell, F.col("ts")), ("entry_price", buy, F.col("price") * (1 + slippage)), ("exit_price", sell, F.col("price") * (1 - slippage)), ("spent", buy, spent), ("got", sell, F.col("equity")), ("a", buy, F.col("bar")), ("b", sell, F.col("bar")))])
    )
    pnl = F.col("got") - F.col("spent")
    return one.where("exit_ts IS NOT NULL").select(*keys, "entry_ts", "exit_ts", "entry_price", "exit_price", pnl.alias("pnl"), F.coalesce(F.try_divide(pnl, F.col("spent")), F.lit(0.0)).alias("return"), (F.col("b") - F.col("a")).cast("bigint").alias("bars_held"))


def backtest_trades(df: DataFrame, capital: float, commission: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Closed trades ``(keys, entry_ts, exit_ts, entry_price, exit_price, pnl, return, bars_held)``."""
    return _trades(_simulate(df, capital, commission, slippage, keys), keys, commission, slippage)


def backtest_stats(df: DataFrame, capital: float, commission: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, metric, value)``: the statistics of ``METRICS`` for each key with rows, a year being 252 rows."""
    e = materialize(_simulate(df, capital, commission, slippage, keys))  # read for the rows and for the trades
    run = scan(e, keys, ["ts", "bar"], day("ts"), greatest={"peak": F.col("equity")})
    r = F.when((F.col("bar") > 1) & (F.col("equity") > 0) | (F.col("factor") == 0), F.col("factor") - 1)
    bars = run.groupBy(*keys).agg(
        F.max_by("equity", "bar").alias("final_equity"), F.count("*").alias("n"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean"),
        F.min(F.least(F.lit(0.0), F.when(F.col("peak") > 0, F.col("equity") / F.col("peak") - 1))).alias("max_drawdown"),
    )
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") > 0, 0.0).otherwise(-F.col("pnl")))
    trades = _trades(e, keys, commission, slippage).groupBy(*keys).agg(F.count("*").alias("trades"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"), gain.alias("gain"), loss.alias("loss"))
    # the two results of a key meet as rows, which needs no join
    whole = bars.unionByName(trades, allowMissingColumns=True)
    both = whole.groupBy(*keys).agg(*[F.max(x).alias(x) for x in whole.columns if x not in keys]).where("n > 0")
    c, n = F.lit(float(capital)), F.col("n").cast("double")
    years = (n - 1) / 252
    trades_n, gain, loss = F.coalesce("trades", F.lit(0)).cast("double"), F.coalesce("gain", F.lit(0.0)), F.coalesce("loss", F.lit(0.0))
    values = {
        "initial_capital": c, "final_equity": F.col("final_equity"), "total_return": F.col("final_equity") / c - 1, "num_bars": n, "num_trades": trades_n,
        "cagr": F.when((n > 1) & (F.col("final_equity") > 0), F.pow(F.col("final_equity") / c, 1 / F.when(n > 1, years)) - 1).otherwise(0.0),
        "annualized_volatility": F.col("sd") * 252**0.5, "sharpe_ratio": F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * 252**0.5).otherwise(0.0), "max_drawdown": F.col("max_drawdown"),
        "win_rate": F.coalesce(F.try_divide(F.col("wins").cast("double"), trades_n), F.lit(0.0)),
        "profit_factor": F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(0.0),
    }
    return both.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), values[m].cast("double").alias("value")) for m in METRICS])))
