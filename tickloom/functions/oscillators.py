"""Oscillators, volatility and volume indicators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.series import ColumnOrName, column, complete, fold, framed, number, ordered, positive, tail
from tickloom.functions.trend import average_range


def atr(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Average true range; null for one bar, the plain mean below ``period`` ranges."""
    return average_range(ordered(ts, over, h=high, l=low, c=close), positive(period, 14))


def rsi(value: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Relative strength index with Wilder's smoothing; null below ``period`` changes, 100 without losses."""
    p = positive(period, 14)

    def step(a: Column, x: Column) -> dict[str, Column]:
        change = x["v"] - a["v"]
        n = F.when(a["v"].isNull(), 0.0).otherwise(a["n"] + 1)
        smooth = lambda old, new: F.when(n == 0, 0.0).when(n <= p, old + new / p).otherwise((old * (p - 1) + new) / p)
        return {"n": n, "v": x["v"], "g": smooth(a["g"], F.greatest(change, F.lit(0.0))), "l": smooth(a["l"], F.greatest(-change, F.lit(0.0)))}

    value_of = lambda a: F.when(a["n"] >= p, F.when(a["l"] == 0, 100.0).otherwise(100 - 100 / (1 + a["g"] / a["l"])))
    return fold(ordered(ts, over, v=value), {"n": 0, "v": None, "g": 0, "l": 0}, step, value_of)


def rsi_rows(value: ColumnOrName, period: int, window: WindowSpec) -> Column:
    """``rsi`` over this row and the ``period`` before it, from sums of lags without arrays; null where there are fewer.

    ``window`` has the partitioning and order, but no frame; a null among the rows gives null.
    """
    v, p = number(value), positive(period, 14)
    prices = [F.lag(v, j).over(window) for j in range(p + 1)]
    up, down = F.lit(0.0), F.lit(0.0)
    for now, then in zip(prices, prices[1:]):
        up += F.greatest(now - then, 0 * now * then)  # null where either is
        down += F.greatest(then - now, 0 * now * then)
    return F.when(down == 0, 100.0).when(down > 0, 100 - 100 / (1 + up / down))


def _range(high, low, close, ts, period, over, finish) -> Column:
    last = tail(ordered(ts, over, h=high, l=low, c=close), positive(period, 14))
    top, bottom = F.array_max(F.transform(last, lambda x: x["h"])), F.array_min(F.transform(last, lambda x: x["l"]))
    return finish(F.get(last, F.size(last) - 1)["c"], top, bottom)


def stochastic_k(close: ColumnOrName, high: ColumnOrName, low: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Place of the last close in the range of ``period`` bars in percent; 50 without range."""
    return _range(high, low, close, ts, period, over, lambda c, h, l: F.when(h == l, 50.0).otherwise(100 * (c - l) / (h - l)))  # noqa: E741


def williams_r(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Distance of the last close from the top of the range, from -100 to 0; null without range."""
    return _range(high, low, close, ts, period, over, lambda c, h, l: F.when(h > l, -100 * (h - c) / (h - l)))  # noqa: E741


def mfi(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, volume: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Money flow index over the last ``period`` changes; null for one bar, 100 without negative flow."""
    series = ordered(ts, over, h=high, l=low, c=close, v=volume)

    def step(a: Column, x: Column) -> dict[str, Column]:
        p = (x["h"] + x["l"] + x["c"]) / 3
        return {"p": p, "up": a["up"] + F.when(p > a["p"], p * x["v"]).otherwise(0.0), "down": a["down"] + F.when(p < a["p"], p * x["v"]).otherwise(0.0)}

    flow = fold(tail(series, positive(period, 14) + 1), {"p": None, "up": 0, "down": 0}, step, lambda a: F.when(a["down"] == 0, 100.0).otherwise(100 - 100 / (1 + a["up"] / a["down"])))
    return F.when(F.size(series) >= 2, flow)


def _flow(h: Column, l: Column, c: Column, v: Column) -> Column:  # noqa: E741
    """Volume by the place of the close in the bar's range, from -volume to volume; 0 without range."""
    return F.coalesce(F.try_divide((c - l) - (h - c), h - l), F.lit(0.0)) * v


def cmf(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, volume: ColumnOrName, ts: ColumnOrName, period: int = 20, over: WindowSpec | None = None) -> Column:
    """Chaikin money flow of the last ``period`` bars; 0 without volume."""
    last = tail(ordered(ts, over, h=high, l=low, c=close, v=volume), positive(period, 20))
    step = lambda a, x: {"f": a["f"] + _flow(x["h"], x["l"], x["c"], x["v"]), "v": a["v"] + x["v"]}
    return fold(last, {"f": 0, "v": 0}, step, lambda a: F.coalesce(F.try_divide(a["f"], a["v"]), F.lit(0.0)))


def ad_line(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, volume: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Accumulation and distribution; the order of rows does not matter."""
    h, l, c, v = map(number, (high, low, close, volume))  # noqa: E741
    return framed(F.sum(complete(_flow(h, l, c, v), h, l, c, v, column(ts))), over)


def obv(close: ColumnOrName, volume: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """On-balance volume: volume signed by the change of the close; the first bar gives 0."""
    step = lambda a, x: {"c": x["c"], "s": a["s"] + F.coalesce(F.signum(x["c"] - a["c"]), F.lit(0.0)) * x["v"]}
    return fold(ordered(ts, over, c=close, v=volume), {"c": None, "s": 0}, step, lambda a: a["s"])


def vwap(price: ColumnOrName, volume: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean price weighted by volume; null without volume."""
    p, v = number(price), number(volume)
    return F.try_divide(framed(F.sum(p * v), over), framed(F.sum(complete(v, p)), over))


def _heikin_ashi(open_, high, low, close, ts, over, finish) -> Column:
    def step(a: Column, x: Column) -> dict[str, Column]:
        o = F.coalesce((a["o"] + a["c"]) / 2, (x["o"] + x["c"]) / 2)
        return {"o": o, "c": (x["o"] + x["h"] + x["l"] + x["c"]) / 4, "h": x["h"], "l": x["l"]}

    return fold(ordered(ts, over, o=open_, h=high, l=low, c=close), {"o": None, "c": None, "h": None, "l": None}, step, finish)


def ha_open(open_: ColumnOrName, high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Open of the last Heikin-Ashi candle."""
    return _heikin_ashi(open_, high, low, close, ts, over, lambda a: a["o"])


def ha_high(open_: ColumnOrName, high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """High of the last Heikin-Ashi candle."""
    return _heikin_ashi(open_, high, low, close, ts, over, lambda a: F.greatest(a["h"], a["o"], a["c"]))


def ha_low(open_: ColumnOrName, high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Low of the last Heikin-Ashi candle."""
    return _heikin_ashi(open_, high, low, close, ts, over, lambda a: F.least(a["l"], a["o"], a["c"]))


def ha_close(open_: ColumnOrName, high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Close of the last Heikin-Ashi candle."""
    o, h, l, c = map(number, (open_, high, low, close))  # noqa: E741
    t = column(ts)
    return framed(F.max_by((o + h + l + c) / 4, complete(t, o, h, l, c)), over)
