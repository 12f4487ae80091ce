"""First and last values, returns, risk and portfolio measures."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.series import ColumnOrName, column, complete, fold, framed, number, ordered

DAY = 86_400_000_000
YEAR = 252.0
INF = float("inf")


def first_s(value: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """The value at the least time; rows with a null in either do not count."""
    v = column(value)
    return framed(F.min_by(v, complete(column(ts), v)), over)


def last_s(value: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """The value at the greatest time; rows with a null in either do not count."""
    v = column(value)
    return framed(F.max_by(v, complete(column(ts), v)), over)


def volatility(x: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Population standard deviation."""
    return framed(F.stddev_pop(number(x)), over)


def sma(x: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean; the window gives the period."""
    return framed(F.avg(number(x)), over)


def cumulative_return(price: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Return from the first to the last price; null if the first is 0."""
    p = number(price)
    first, last = first_s(p, ts, over), last_s(p, ts, over)
    return F.try_divide(last - first, first)


def sharpe_ratio(ret: ColumnOrName, rate: float | ColumnOrName = 0.0, over: WindowSpec | None = None) -> Column:
    """Mean excess return by population deviation, per period; null below two returns or without deviation."""
    r = number(ret)
    free = number(rate) if not isinstance(rate, (str, Column)) else framed(F.any_value(number(rate), F.lit(True)), over)
    return F.when(framed(F.count(r), over) >= 2, F.try_divide(framed(F.avg(r), over) - free, framed(F.stddev_pop(r), over)))


def sortino_ratio(ret: ColumnOrName, rate: float = 0.0, over: WindowSpec | None = None) -> Column:
    """Mean excess return by the deviation below the rate; null below two returns or without deviation."""
    r = number(ret)
    short = F.least(r - rate, F.lit(0.0)) + r * 0  # null where the return is
    below = F.sqrt(framed(F.sum(short * short), over) / F.nullif(framed(F.count(r), over), F.lit(0)))
    return F.when(framed(F.count(r), over) >= 2, F.try_divide(framed(F.avg(r), over) - rate, below))


def max_drawdown(price: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Worst fall from a peak as a negative share; null below two prices."""
    series = ordered(ts, over, v=price)

    def step(a: Column, x: Column) -> dict[str, Column]:
        peak = F.greatest(a["peak"], x["v"])
        return {"peak": peak, "d": F.when(peak > 0, F.least(a["d"], (x["v"] - peak) / peak)).otherwise(a["d"])}

    return F.when(F.size(series) >= 2, fold(series, {"peak": None, "d": 0}, step, lambda a: a["d"]))


def value_at_risk(ret: ColumnOrName, confidence: float = 0.95, over: WindowSpec | None = None) -> Column:
    """The loss at a quantile of the returns, interpolated; null below two returns."""
    r = number(ret)
    return F.when(framed(F.count(r), over) >= 2, -framed(F.percentile(r, F.lit(1 - confidence)), over))


def _pair(a: ColumnOrName, b: ColumnOrName) -> tuple[Column, Column]:
    x, y = number(a), number(b)
    return complete(x, y), complete(y, x)


def portfolio_correlation(a: ColumnOrName, b: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Pearson's correlation; null below two pairs, 0 without variance."""
    x, y = _pair(a, b)
    n = framed(F.count(complete(x, y)), over)
    spread = framed(F.var_pop(x), over) * framed(F.var_pop(y), over)
    return F.when(n >= 2, F.when(spread > 0, framed(F.covar_pop(x, y), over) / F.sqrt(spread)).otherwise(0.0))


def portfolio_beta(asset: ColumnOrName, bench: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Covariance with the benchmark by its variance; null below two pairs or without variance."""
    x, y = _pair(asset, bench)
    return F.when(framed(F.count(complete(x, y)), over) >= 2, F.try_divide(framed(F.covar_pop(x, y), over), framed(F.var_pop(y), over)))


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def momentum_score(value: ColumnOrName, ts: ColumnOrName, period_days: int = 252, over: WindowSpec | None = None) -> Column:
    """Return since the first row within ``period_days`` calendar days of the last; null below two rows or if it is 0."""
    series = ordered(ts, over, v=value)
    last = F.get(series, F.size(series) - 1)
    recent = F.filter(series, lambda x: _micros(x["t"]) >= _micros(last["t"]) - period_days * DAY)
    first = F.get(recent, F.lit(0))["v"]
    return F.when(F.size(series) >= 2, F.try_divide(last["v"] - first, first))


def relative_strength(asset: ColumnOrName, bench: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Growth of the asset by growth of the benchmark; null below two rows or where a divisor is 0."""
    x, y = number(asset), number(bench)
    t = complete(column(ts), x, y)
    first, last = (framed(f(F.struct(x.alias("a"), y.alias("b")), t), over) for f in (F.min_by, F.max_by))
    return F.when(framed(F.count(t), over) >= 2, F.try_divide(F.try_divide(last["a"], first["a"]), F.try_divide(last["b"], first["b"])))


def drawdown_duration(value: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Longest time from a peak to its recovery, or to the end, in whole days; null below two rows.

    A drawdown begins at the first row anywhere that has the value of the peak.
    """
    series = ordered(ts, over, v=value)

    def step(a: Column, x: Column) -> dict[str, Column]:
        t, up = _micros(x["t"]), F.coalesce(x["v"] >= a["peak"], F.lit(True))
        done = F.when(up & (a["down"] == 1), F.greatest(a["best"], F.floor((t - a["since"]) / DAY))).otherwise(a["best"])
        # equal peaks keep the time of the first
        since = F.when(a["peak"].isNull() | (x["v"] > a["peak"]), t).otherwise(a["since"])
        return {"peak": F.greatest(a["peak"], x["v"]), "since": since, "down": F.when(up, 0).otherwise(1), "best": done, "t": t}

    open_ = lambda a: F.when(a["down"] == 1, F.greatest(a["best"], F.floor((a["t"] - a["since"]) / DAY))).otherwise(a["best"])
    return F.when(F.size(series) >= 2, fold(series, {"peak": None, "since": None, "down": 0, "best": 0, "t": None}, step, open_).cast("bigint"))


def _gain(r: Column) -> Column:
    return F.when(r > 0, r)


def _loss(r: Column) -> Column:
    return F.when(r < 0, -r)


def _total(c: Column, over) -> Column:
    return F.coalesce(framed(F.sum(c), over), F.lit(0.0))


def profit_factor(ret: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Sum of gains by sum of losses; infinite without losses, null without either."""
    r = number(ret)
    wins, losses = _total(_gain(r), over), _total(_loss(r), over)
    return F.when(losses > 0, wins / losses).when(wins > 0, F.lit(INF))


def annualized_volatility(ret: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Population deviation for a year of 252 periods; null below two returns."""
    r = number(ret)
    return F.when(framed(F.count(r), over) >= 2, framed(F.stddev_pop(r), over) * YEAR**0.5)


def calmar_ratio(ret: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Annual return by worst fall; infinite without a fall, null below two rows."""
    series = ordered(ts, over, r=ret, v=close)

    def step(a: Column, x: Column) -> dict[str, Column]:
        peak = F.greatest(a["peak"], x["v"])
        t = _micros(x["t"])
        return {"peak": peak, "d": F.greatest(a["d"], F.try_divide(peak - x["v"], peak)), "s": a["s"] + x["r"], "a": F.coalesce(a["a"], t), "b": t}

    def finish(a: Column) -> Column:
        days = F.floor((a["b"] - a["a"]) / DAY)
        year = F.when(days > 0, a["s"] * YEAR / days).otherwise(0.0)
        return F.when(a["d"] > 0, year / a["d"]).otherwise(F.lit(INF))

    return F.when(F.size(series) >= 2, fold(series, {"peak": None, "d": 0, "s": 0, "a": None, "b": None}, step, finish))


def information_ratio(a: ColumnOrName, b: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Annualized mean by deviation of the difference; 0 without deviation, null below two pairs."""
    d = number(a) - number(b)
    spread = framed(F.stddev_pop(d), over)
    return F.when(framed(F.count(d), over) >= 2, F.when(spread > 0, framed(F.avg(d), over) / spread * YEAR**0.5).otherwise(0.0))


def win_rate(ret: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Share of returns above 0."""
    r = number(ret)
    return F.try_divide(framed(F.count(_gain(r)), over).cast("double"), framed(F.count(r), over).cast("double"))


def avg_win_loss_ratio(ret: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean gain by mean loss; null without either."""
    r = number(ret)
    return framed(F.avg(_gain(r)), over) / framed(F.avg(_loss(r)), over)


def expectancy(ret: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean of the returns other than 0."""
    r = number(ret)
    n = framed(F.count(F.nullif(r, F.lit(0.0))), over)
    return F.try_divide(_total(_gain(r), over) - _total(_loss(r), over), n.cast("double"))
