"""Queries of the table functions: bars, returns, as-of joins, backtests, portfolios, simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import backtest, market, portfolio
from tickloom.plans.views import BARS, DAILY, bars, daily, returns, ticks
from tickloom.session import table

CAPITAL, COMMISSION, SLIPPAGE = 10_000.0, 0.001, 0.0005


def _us(column: str) -> Column:
    return F.unix_micros(column).alias(f"{column}_us")


def _price(digits: int) -> Column:
    """Prices are quotients of few digits and lie on ties of the rounding; the shift settles them upwards."""
    return F.round(F.col("price") + 1e-9, digits).alias("price")


def resample_ohlc(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars from those of six hours."""
    weekly = market.resample_ohlc(bars(spark, sf), "1 week", ["symbol"])
    return weekly.select("symbol", _us("ts"), "open", "high", "low", "close", "volume")


def with_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = market.with_returns(daily(spark, sf))
    return rows.select(_us("ts"), _price(6), *[F.round(c, 6).alias(c) for c in ("simple_return", "log_return")])


def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase with the last view before it."""
    all_ticks = ticks(spark, sf)
    bought, seen = (all_ticks.where(F.col("symbol") == s).select("ts", "price") for s in ("purchase", "view"))
    return market.asof_join(bought, seen, "ts").select(_us("ts"), "price", _us("ts_r"), "price_r")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """BUY and SELL by the sign of the difference of means over 5 and 20 days of the daily market."""
    w = Window.orderBy("ts")
    # one row per day of shipment: a series whose length the calendar bounds
    short, long = (F.avg("price").over(w.rowsBetween(1 - n, 0)) for n in (5, 20))
    return daily(spark, sf).select("ts", "price", F.when(short > long, "BUY").when(short < long, "sell").otherwise("HOLD").alias("signal"))


def backtest_equity(spark: SparkSession, sf: str) -> DataFrame:
    e = backtest.backtest_equity(signals(spark, sf), CAPITAL, COMMISSION, SLIPPAGE)
    return e.select(_us("ts"), _price(4), *[F.round(c, 4).alias(c) for c in ("position", "cash", "equity")])


def backtest_trades(spark: SparkSession, sf: str) -> DataFrame:
    t = backtest.backtest_trades(signals(spark, sf), CAPITAL, COMMISSION, SLIPPAGE)
    return t.select(_us("entry_ts"), _us("exit_ts"), *[F.round(c, 4).alias(c) for c in ("entry_price", "exit_price", "pnl", "return")], "bars_held")


def backtest_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = backtest.backtest_stats(signals(spark, sf), CAPITAL, COMMISSION, SLIPPAGE)
    return s.select("metric", F.round("value", 4).alias("value"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of the symbols at the times at which all have one."""
    rows = returns(spark, sf).where("ret IS NOT NULL").select("ts", "symbol", F.col("ret").alias("return"))
    n = rows.agg(F.countDistinct("symbol").alias("k"))
    full = rows.groupBy("ts").agg(F.count("*").alias("k")).join(n, "k").select("ts")
    return rows.join(full, "ts")


#: Riskless return of a period, and points of the frontier.
RATE, POINTS = 0.001, 10


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def min_variance_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(portfolio.min_variance_portfolio(panel(spark, sf)))


def max_sharpe_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(portfolio.max_sharpe_portfolio(panel(spark, sf), RATE))


def efficient_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(portfolio.efficient_frontier(panel(spark, sf), POINTS, RATE))


def monte_carlo(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 paths of 100 days from the mean price of the daily market."""
    start = daily(spark, sf).agg(F.avg("price")).first()[0]
    return portfolio.monte_carlo(spark, start, 0.05, 0.2, 100, 1_000, seed=7)


def monte_carlo_moments(spark: SparkSession, sf: str) -> DataFrame:
    """For each day the paths, and whether mean and deviation of their logarithms are within four standard errors of those of the process."""
    paths = monte_carlo(spark, sf)
    x = F.ln(F.col("price") / F.col("start"))
    first = paths.where("day = 0").select("path_id", F.col("price").alias("start"))
    days = paths.join(first, "path_id").groupBy("day").agg(F.count("*").alias("paths"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    mean, sd = F.col("day") * (0.05 - 0.2**2 / 2) / 252, 0.2 * F.sqrt(F.col("day") / 252.0)
    near = F.abs(F.col("m") - mean) <= 4 * sd / F.sqrt("paths")
    return days.select(F.col("day").cast("bigint").alias("day"), "paths", near.alias("mean_holds"), (F.abs(F.col("sd") - sd) <= 4 * sd / F.sqrt(2.0 * F.col("paths"))).alias("deviation_holds"))


def asof_join_by(spark: SparkSession, sf: str) -> DataFrame:
    """Every event of a user with that user's last purchase before it or at its time."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("paid"))
    met = market.asof_join(events, bought, "ts", ["user_id"])
    return met.select("user_id", _us("ts"), "event_type", "value", _us("ts_r"), "paid")


def min_variance_check(spark: SparkSession, sf: str) -> DataFrame:
    """Covariances of the panel that the portfolios are solved from."""
    symbols, mu, cov, n = portfolio.moments(panel(spark, sf))
    rows = [(a, b, round(float(cov[i, j]), 6)) for i, a in enumerate(symbols) for j, b in enumerate(symbols)]
    return spark.createDataFrame(rows, "a string, b string, covariance double")


QUERIES = {
    f.__name__: f
    for f in (resample_ohlc, with_returns, asof_join, backtest_equity, backtest_trades, backtest_stats, min_variance_portfolio, max_sharpe_portfolio, efficient_frontier, monte_carlo, monte_carlo_moments, asof_join_by, min_variance_check)
}

_SIM = f"""{DAILY},
sma AS (SELECT ts, price, avg(price) OVER (ORDER BY ts ROWS 4 PRECEDING) AS a, avg(price) OVER (ORDER BY ts ROWS 19 PRECEDING) AS b FROM daily),
turns AS (SELECT ts, price, row_number() OVER (ORDER BY ts) AS i, coalesce(last_value(CASE WHEN a > b THEN 1 WHEN a < b THEN 0 END IGNORE NULLS) OVER (ORDER BY ts), 0) AS long FROM sma),
moves AS (SELECT *, coalesce(lag(long) OVER (ORDER BY ts), 0) AS was, price / lag(price) OVER (ORDER BY ts) AS kept FROM turns),
eq AS (SELECT *, {CAPITAL!r} * product(CASE WHEN long = 1 AND was = 0 THEN 1 / (1.001::DOUBLE * 1.0005::DOUBLE) WHEN long = 1 THEN kept WHEN was = 1 THEN kept * (0.999::DOUBLE * 0.9995::DOUBLE) ELSE 1::DOUBLE END) OVER (ORDER BY ts) AS equity,
 sum(CASE WHEN long = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS trade FROM moves),
trades AS (SELECT trade, max(ts) FILTER (WHERE long = 1) AS entry_ts, max(ts) FILTER (WHERE long = 0) AS exit_ts, max(price) FILTER (WHERE long = 1) * 1.0005 AS entry_price, max(price) FILTER (WHERE long = 0) * 0.9995 AS exit_price,
 max(equity) FILTER (WHERE long = 1) * 1.001::DOUBLE * 1.0005::DOUBLE AS spent, max(equity) FILTER (WHERE long = 0) AS got, max(i) FILTER (WHERE long = 0) - max(i) FILTER (WHERE long = 1) AS bars_held
 FROM eq WHERE long <> was GROUP BY trade HAVING max(ts) FILTER (WHERE long = 0) IS NOT NULL)"""
_PANEL = f"""{BARS}, r AS (SELECT ts, symbol, ret FROM b WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) = (SELECT count(DISTINCT symbol) FROM b WHERE ret IS NOT NULL))"""
# covariances with the ridge beside ones, means and excess means, brought to the identity row by row
_SOLVED = f"""WITH RECURSIVE {_PANEL},
means AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i, avg(ret) AS mu FROM r GROUP BY symbol),
cov AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS c FROM r x JOIN r y USING (ts) GROUP BY ALL),
ridge AS (SELECT greatest(1e-10, abs(sum(c)) * 1e-10 / count(*)) AS e FROM cov WHERE a = b),
start AS (SELECT list(line || [1::DOUBLE, mu, mu - {RATE!r}] ORDER BY a) AS m FROM (SELECT a, list(c + CASE WHEN a = b THEN e ELSE 0 END ORDER BY b) AS line FROM cov CROSS JOIN ridge GROUP BY a) JOIN means ON a = symbol),
steps AS (SELECT 1 AS k, m FROM start UNION ALL
 SELECT k + 1, list_transform(range(1, len(m) + 1), lambda j: list_transform(range(1, len(m) + 4), lambda c: CASE WHEN j = k THEN m[k][c] / m[k][k] ELSE m[j][c] - m[j][k] * m[k][c] / m[k][k] END)) FROM steps WHERE k <= len(m)),
x AS (SELECT symbol, mu, m[i][len(m) + 1] AS one, m[i][len(m) + 2] AS mean, m[i][len(m) + 3] AS excess FROM (SELECT m FROM steps WHERE k > len(m)) CROSS JOIN means)"""
_RISKS = "risks AS (SELECT {0} sum(p.w * q.w * c) AS risk FROM w p JOIN w q {1} JOIN cov ON p.symbol = a AND q.symbol = b {2})"
_WEIGHTS = _SOLVED + """, w AS (SELECT symbol, mu, {0} / sum({0}) OVER () AS w FROM x), """ + _RISKS.format("", "ON true", "") + """
SELECT symbol, round(w, 6) + 0.0 AS weight, round(sum(w * mu) OVER (), 6) + 0.0 AS expected_return, round(sqrt(risk), 6) AS volatility FROM w CROSS JOIN risks"""
ORACLE = {
    "min_variance_portfolio": _WEIGHTS.format("one"),
    "max_sharpe_portfolio": _WEIGHTS.format("excess"),
    "efficient_frontier": f"""{_SOLVED}, s AS (SELECT sum(one) AS a, sum(mean) AS b, sum(mean * mu) AS c, least(sum(one * mu) / sum(one), min(mu)) AS low, max(mu) AS high FROM x),
t AS (SELECT *, k AS point_id, low + k * (high - low) / {POINTS - 1} AS target FROM s CROSS JOIN range({POINTS}) AS g(k)),
w AS (SELECT point_id, symbol, mu, (one * (c - b * target) + mean * (a * target - b)) / (a * c - b * b) AS w FROM t CROSS JOIN x),
{_RISKS.format("point_id,", "USING (point_id)", "GROUP BY point_id")}, g AS (SELECT *, sum(w * mu) OVER (PARTITION BY point_id) AS gain FROM w)
SELECT CAST(point_id AS INTEGER) AS point_id, symbol, round(w, 6) + 0.0 AS weight, round(gain, 6) + 0.0 AS expected_return, round(sqrt(risk), 6) AS volatility, round((gain - {RATE!r}) / sqrt(risk), 6) + 0.0 AS sharpe_ratio FROM g JOIN risks USING (point_id)""",
    "monte_carlo_moments": "SELECT day, CAST(1000 AS BIGINT) AS paths, true AS mean_holds, true AS deviation_holds FROM range(101) AS d(day)",
    "asof_join_by": "WITH p AS (SELECT user_id, ts, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT l.user_id, epoch_us(l.ts) AS ts_us, l.event_type, l.value, epoch_us(p.ts) AS ts_r_us, p.paid FROM events l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.ts >= p.ts",
    "resample_ohlc": f"WITH {BARS} SELECT symbol, epoch_us(time_bucket(INTERVAL 7 DAY, ts)) AS ts_us, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, time_bucket(INTERVAL 7 DAY, ts)",
    "with_returns": f"WITH {DAILY} SELECT epoch_us(ts) AS ts_us, round(price + 1e-9, 6) AS price, round(price / nullif(lag(price) OVER w, 0) - 1, 6) + 0.0 AS simple_return, round(ln(price / nullif(lag(price) OVER w, 0)), 6) + 0.0 AS log_return FROM daily WINDOW w AS (ORDER BY ts)",
    "asof_join": "WITH l AS (SELECT ts, value AS price FROM events WHERE event_type = 'purchase'), r AS (SELECT ts, value AS price FROM events WHERE event_type = 'view') SELECT epoch_us(l.ts) AS ts_us, l.price, epoch_us(r.ts) AS ts_r_us, r.price AS price_r FROM l ASOF LEFT JOIN r ON l.ts >= r.ts",
    "backtest_equity": f"WITH {_SIM} SELECT epoch_us(ts) AS ts_us, round(price + 1e-9, 4) AS price, CASE WHEN long = 1 THEN round(equity / price, 4) ELSE 0 END AS position, CASE WHEN long = 1 THEN 0 ELSE round(equity, 4) END AS cash, round(equity, 4) AS equity FROM eq",
    "backtest_trades": f'WITH {_SIM} SELECT epoch_us(entry_ts) AS entry_ts_us, epoch_us(exit_ts) AS exit_ts_us, round(entry_price, 4) AS entry_price, round(exit_price, 4) AS exit_price, round(got - spent, 4) + 0.0 AS pnl, round((got - spent) / spent, 4) + 0.0 AS "return", bars_held FROM trades',
    "backtest_stats": f"""WITH {_SIM}, w AS (SELECT *, equity / lag(equity) OVER (ORDER BY ts) - 1 AS r, equity / max(equity) OVER (ORDER BY ts) - 1 AS dd FROM eq),
s AS (SELECT arg_max(equity, ts) AS f, CAST(count(*) AS DOUBLE) AS n, stddev_samp(r) AS sd, avg(r) AS m, min(dd) AS dd FROM w),
t AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(count(*) FILTER (WHERE got > spent) AS DOUBLE) AS wins, sum(got - spent) FILTER (WHERE got > spent) AS gain, sum(spent - got) FILTER (WHERE got <= spent) AS loss FROM trades)
SELECT metric, round(CAST(value AS DOUBLE), 4) + 0.0 AS value FROM (SELECT unnest(['initial_capital', 'final_equity', 'total_return', 'num_bars', 'num_trades', 'cagr', 'annualized_volatility', 'sharpe_ratio', 'max_drawdown', 'win_rate', 'profit_factor']) AS metric,
 unnest([{CAPITAL!r}::DOUBLE, f, f / {CAPITAL!r}::DOUBLE - 1, n, k, power(f / {CAPITAL!r}::DOUBLE, 252 / (n - 1)) - 1, sd * sqrt(252), m / sd * sqrt(252), dd, wins / k, coalesce(gain, 0) / loss]) AS value FROM s CROSS JOIN t)""",
    "min_variance_check": f"WITH {_PANEL} SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret), 6) AS covariance FROM r x JOIN r y USING (ts) GROUP BY ALL",
}
