"""Moving averages, bands and trend strength as ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.series import ColumnOrName, fold, number, ordered, positive, tail


def _ema_step(previous: Column, value: Column, period: int) -> Column:
    k = 2.0 / (period + 1)
    return F.coalesce(value * k + previous * (1 - k), value)


def ema(value: ColumnOrName, ts: ColumnOrName, period: int = 12, over: WindowSpec | None = None) -> Column:
    """Exponential moving average, from the first value on; a period of 0 or less counts as 1."""
    p = max(period, 1)
    return fold(ordered(ts, over, v=value), {"e": None}, lambda a, x: {"e": _ema_step(a["e"], x["v"], p)}, lambda a: a["e"])


def ema_rows(value: ColumnOrName, period: int, window: WindowSpec, rows: int) -> Column:
    """``ema`` over this row and the ``rows`` - 1 before it, as a weighted sum of lags without arrays.

    ``window`` has the partitioning and order, but no frame; a null among the rows gives null.
    """
    v, k = number(value), 2.0 / (max(period, 1) + 1)
    n = F.least(F.row_number().over(window), F.lit(rows))
    total = F.lit(0.0)
    for j in range(rows):  # the first row of the frame starts the average
        weight = F.lit((1 - k) ** j) if j == rows - 1 else F.when(n == j + 1, (1 - k) ** j).otherwise(k * (1 - k) ** j)
        total += F.lag(v, j, 0.0).over(window) * weight
    return total


def _levels(value, ts, period, over, finish) -> Column:
    if period <= 0:
        return F.lit(None).cast("double")

    def step(a: Column, x: Column) -> dict[str, Column]:
        e1 = _ema_step(a["e1"], x["v"], period)
        e2 = _ema_step(a["e2"], e1, period)
        return {"e1": e1, "e2": e2, "e3": _ema_step(a["e3"], e2, period)}

    return fold(ordered(ts, over, v=value), {"e1": None, "e2": None, "e3": None}, step, finish)


def dema(value: ColumnOrName, ts: ColumnOrName, period: int, over: WindowSpec | None = None) -> Column:
    """Double exponential moving average; null for a period of 0 or less."""
    return _levels(value, ts, period, over, lambda a: 2 * a["e1"] - a["e2"])


def tema(value: ColumnOrName, ts: ColumnOrName, period: int, over: WindowSpec | None = None) -> Column:
    """Triple exponential moving average; null for a period of 0 or less."""
    return _levels(value, ts, period, over, lambda a: 3 * a["e1"] - 3 * a["e2"] + a["e3"])


def wma(value: ColumnOrName, ts: ColumnOrName, period: int = 20, over: WindowSpec | None = None) -> Column:
    """Mean of the last ``period`` values with weights 1, 2, ... from the oldest."""
    last = tail(ordered(ts, over, v=value), positive(period, 20))
    return fold(last, {"i": 0, "s": 0}, lambda a, x: {"i": a["i"] + 1, "s": a["s"] + (a["i"] + 1) * x["v"]}, lambda a: a["s"] / (a["i"] * (a["i"] + 1) / 2))


def macd_line(value: ColumnOrName, ts: ColumnOrName, fast: int = 12, slow: int = 26, over: WindowSpec | None = None) -> Column:
    """Difference of a fast and a slow exponential moving average."""
    f, s = positive(fast, 12), positive(slow, 26)
    return fold(ordered(ts, over, v=value), {"f": None, "s": None}, lambda a, x: {"f": _ema_step(a["f"], x["v"], f), "s": _ema_step(a["s"], x["v"], s)}, lambda a: a["f"] - a["s"])


macd = macd_line


def _band(value, ts, period, over, finish) -> Column:
    last = tail(ordered(ts, over, v=value), positive(period, 20))
    mean = fold(last, {"n": 0, "s": 0}, lambda a, x: {"n": a["n"] + 1, "s": a["s"] + x["v"]}, lambda a: a["s"] / a["n"])
    square = F.aggregate(last, F.lit(0.0).cast("double"), lambda a, x: a + (x["v"] - mean) * (x["v"] - mean))
    return finish(mean, F.sqrt(F.try_divide(square, F.size(last).cast("double"))))


def bollinger_middle(value: ColumnOrName, ts: ColumnOrName, period: int = 20, num_std: float = 2.0, over: WindowSpec | None = None) -> Column:
    """Mean of the last ``period`` values."""
    return _band(value, ts, period, over, lambda m, s: m)


def bollinger_upper(value: ColumnOrName, ts: ColumnOrName, period: int = 20, num_std: float = 2.0, over: WindowSpec | None = None) -> Column:
    """The mean and ``num_std`` population deviations."""
    return _band(value, ts, period, over, lambda m, s: m + num_std * s)


def bollinger_lower(value: ColumnOrName, ts: ColumnOrName, period: int = 20, num_std: float = 2.0, over: WindowSpec | None = None) -> Column:
    """The mean less ``num_std`` population deviations."""
    return _band(value, ts, period, over, lambda m, s: m - num_std * s)


def bollinger_width(value: ColumnOrName, ts: ColumnOrName, period: int = 20, num_std: float = 2.0, over: WindowSpec | None = None) -> Column:
    """Distance of the bands by their mean; 0 where the mean is not above 0."""
    return _band(value, ts, period, over, lambda m, s: F.when(m > 0, 2 * num_std * s / m).when(m <= 0, 0.0))


def true_range(x: Column, previous: Column) -> Column:
    return F.greatest(x["h"] - x["l"], F.abs(x["h"] - previous), F.abs(x["l"] - previous))


def _bars(high, low, close, ts, over) -> Column:
    return ordered(ts, over, h=high, l=low, c=close)


def average_range(series: Column, period: int) -> Column:
    """Wilder's mean of the true ranges: null for one bar, the plain mean for less than ``period`` ranges."""

    def step(a: Column, x: Column) -> dict[str, Column]:
        tr = true_range(x, a["c"])
        n = F.when(a["c"].isNull(), a["n"]).otherwise(a["n"] + 1)
        s = F.when(a["c"].isNotNull() & (n <= period), a["s"] + tr).otherwise(a["s"])
        m = F.when(n <= period, F.try_divide(s, n)).otherwise((a["m"] * (period - 1) + tr) / period)
        return {"n": n, "c": x["c"], "s": s, "m": m}

    return fold(series, {"n": 0, "c": None, "s": 0, "m": None}, step, lambda a: a["m"])


def keltner_middle(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 20, multiplier: float = 2.0, over: WindowSpec | None = None) -> Column:
    """Exponential moving average of the close."""
    p = positive(period, 20)
    return fold(_bars(high, low, close, ts, over), {"e": None}, lambda a, x: {"e": _ema_step(a["e"], x["c"], p)}, lambda a: a["e"])


def keltner_upper(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 20, multiplier: float = 2.0, over: WindowSpec | None = None) -> Column:
    """The middle and ``multiplier`` average true ranges."""
    return keltner_middle(high, low, close, ts, period, multiplier, over) + multiplier * F.coalesce(average_range(_bars(high, low, close, ts, over), positive(period, 20)), F.lit(0.0))


def keltner_lower(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 20, multiplier: float = 2.0, over: WindowSpec | None = None) -> Column:
    """The middle less ``multiplier`` average true ranges."""
    return keltner_middle(high, low, close, ts, period, multiplier, over) - multiplier * F.coalesce(average_range(_bars(high, low, close, ts, over), positive(period, 20)), F.lit(0.0))


def _midpoint(high, low, ts, bars, over) -> Column:
    last = tail(ordered(ts, over, h=high, l=low), bars)
    return (F.array_max(F.transform(last, lambda x: x["h"])) + F.array_min(F.transform(last, lambda x: x["l"]))) / 2


def ichimoku_tenkan(high: ColumnOrName, low: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Middle of the range of the last 9 bars."""
    return _midpoint(high, low, ts, 9, over)


def ichimoku_kijun(high: ColumnOrName, low: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Middle of the range of the last 26 bars."""
    return _midpoint(high, low, ts, 26, over)


def ichimoku_senkou_a(high: ColumnOrName, low: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Mean of the two lines above, not shifted."""
    return (ichimoku_tenkan(high, low, ts, over) + ichimoku_kijun(high, low, ts, over)) / 2


def ichimoku_senkou_b(high: ColumnOrName, low: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Middle of the range of the last 52 bars."""
    return _midpoint(high, low, ts, 52, over)


def _directional(high, low, close, ts, period, over, finish) -> Column:
    p = positive(period, 14)
    series = _bars(high, low, close, ts, over)

    def step(a: Column, x: Column) -> dict[str, Column]:
        first = a["c"].isNull()
        up, down = x["h"] - a["h"], a["l"] - x["l"]
        moves = {"tr": true_range(x, a["c"]), "sp": F.when((up > down) & (up > 0), up).otherwise(0.0), "sm": F.when((down > up) & (down > 0), down).otherwise(0.0)}
        n = F.when(first, 0.0).otherwise(a["n"] + 1)
        s = {k: F.when(first, 0.0).when(n <= p, a[k] + v).otherwise(a[k] - a[k] / p + v) for k, v in moves.items()}
        plus, minus = F.try_divide(100 * s["sp"], s["tr"]), F.try_divide(100 * s["sm"], s["tr"])
        dx = F.coalesce(F.try_divide(100 * F.abs(plus - minus), plus + minus), F.lit(0.0))
        counts = (n >= p) & (s["tr"] > 0)
        k = F.when(counts, a["k"] + 1).otherwise(a["k"])
        total = F.when(counts & (k <= p), a["d"] + dx).otherwise(a["d"])
        adx = F.when(counts & (k > p), (a["x"] * (p - 1) + dx) / p).when(k == p, total / p).otherwise(a["x"])
        return {"n": n, "h": x["h"], "l": x["l"], "c": x["c"], **s, "k": k, "d": total, "x": adx}

    start = {"n": 0, "h": None, "l": None, "c": None, "tr": 0, "sp": 0, "sm": 0, "k": 0, "d": 0, "x": None}
    done = fold(series, start, step, lambda a: F.when(a["k"] >= p, finish(a)))
    return F.when(F.size(series) >= 2 * p + 1, done)


def adx(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Wilder's average directional index; null below 2 * period + 1 bars."""
    return _directional(high, low, close, ts, period, over, lambda a: a["x"])


def plus_di(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Share of upward movement in the true range; 0 without range."""
    return _directional(high, low, close, ts, period, over, lambda a: F.when(a["tr"] > 0, 100 * a["sp"] / a["tr"]).otherwise(0.0))


def minus_di(high: ColumnOrName, low: ColumnOrName, close: ColumnOrName, ts: ColumnOrName, period: int = 14, over: WindowSpec | None = None) -> Column:
    """Share of downward movement in the true range; 0 without range."""
    return _directional(high, low, close, ts, period, over, lambda a: F.when(a["tr"] > 0, 100 * a["sm"] / a["tr"]).otherwise(0.0))
