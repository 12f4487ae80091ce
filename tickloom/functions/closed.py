"""Indicators of whole series without gathering them.

Most recurrences of the ordered aggregates are linear, so their last value is a sum of the values
with weights that follow from each row's place from the start and the end. ``prepare`` gives every
row its place and the row before it without gathering a series; the sums then combine partially
before the shuffle. ADX and its lines forget what lies far back, so that a bounded number of the last rows
gives them. Drawdowns come from running peaks, Hurst's exponent from running sums by chunk. Use these
where a series may be long, the folds where it is short or framed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import trend
from tickloom.functions.returns import DAY, INF, YEAR
from tickloom.operators.scan import day, scan


def prepare(df: DataFrame, keys: Sequence[str], ts: str, fields: Sequence[str], slot: Column | None = None) -> DataFrame:
    """The complete rows with ``_i``, the place from 1 on, ``_n``, the number of rows of the key, ``_e``, its last time, and ``_b``, the fields of the row before.

    Rows follow ``ts``, then ``fields``. ``slot`` is a coarser time, the day of ``ts`` if not given.
    """
    rows = df.select(*keys, ts, *[F.col(f).cast("double").alias(f) for f in fields]).dropna(subset=[ts, *fields])
    place = F.coalesce("_r", F.lit(0)) + 1
    placed = scan(rows, keys, [ts, *fields], day(ts) if slot is None else slot, last={"_b": F.struct(*fields)}, total={"_r": F.lit(1)}, before=True)
    ends = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"), F.max(ts).alias("_e"))
    on = F.lit(True)
    if not keys:  # all rows are one series, and meet their one summary by a number that is 0 on both sides
        placed, ends = placed.withColumn("_z", place * 0), ends.withColumn("_k", F.col("_n") * 0)
        on = F.col("_z") == F.col("_k")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(ends, on).withColumn("_i", place).drop("_r", "_k", "_z", *[f"_k{i}" for i in range(len(keys))])


def _place() -> tuple[Column, Column]:
    return F.col("_i").cast("double"), F.col("_n").cast("double")


def _before(field: str) -> Column:
    return F.col("_b")[field]


def ema(field: str, period: int = 12) -> Column:
    """Exponential moving average."""
    i, n = _place()
    k = 2.0 / (max(period, 1) + 1)
    q = F.lit(1 - k)
    return F.sum(F.col(field) * F.when(i == 1, F.pow(q, n - 1)).otherwise(k * F.pow(q, n - i)))


def _second(field: str, period: int) -> Column:
    i, n = _place()
    k = 2.0 / (period + 1)
    q = F.lit(1 - k)
    return F.sum(F.col(field) * F.when(i == 1, F.pow(q, n - 1) * (1 + k * (n - 1))).otherwise(k * k * (n - i + 1) * F.pow(q, n - i)))


def _third(field: str, period: int) -> Column:
    i, n = _place()
    k = 2.0 / (period + 1)
    q, m = F.lit(1 - k), n - i
    return F.sum(F.col(field) * F.when(i == 1, F.pow(q, n - 1) * (1 + k * (n - 1) + k * k * n * (n - 1) / 2)).otherwise(k**3 * (m + 1) * (m + 2) / 2 * F.pow(q, m)))


def dema(field: str, period: int) -> Column:
    """Double exponential moving average."""
    return 2 * ema(field, period) - _second(field, period)


def tema(field: str, period: int) -> Column:
    """Triple exponential moving average."""
    return 3 * ema(field, period) - 3 * _second(field, period) + _third(field, period)


def macd_line(field: str, fast: int = 12, slow: int = 26) -> Column:
    """Difference of a fast and a slow exponential moving average."""
    return ema(field, fast) - ema(field, slow)


def _recent(value: Column, rows: int) -> Column:
    return F.when(F.col("_i") > F.col("_n") - rows, value)


def wma(field: str, period: int = 20) -> Column:
    """Mean of the last ``period`` values with weights 1, 2, ... from the oldest."""
    i, n = _place()
    weight = _recent(i - n + F.least(F.lit(float(period)), n), period)
    return F.try_divide(F.sum(F.col(field) * weight), F.sum(weight))


def bollinger(field: str, period: int = 20, num_std: float = 2.0) -> dict[str, Column]:
    """The bands ``upper``, ``middle``, ``lower`` and their ``width``."""
    value = _recent(F.col(field), period)
    mean, sd = F.avg(value), F.stddev_pop(value)
    return {"upper": mean + num_std * sd, "middle": mean, "lower": mean - num_std * sd, "width": F.when(mean > 0, 2 * num_std * sd / mean).when(mean <= 0, 0.0)}


def _wilder(value: Column, period: int) -> Column:
    """Weighted part of Wilder's average of the values from the second row on; null below ``period`` of them."""
    i, n = _place()
    q, j, m = F.lit(1 - 1 / period), i - 1, n - 1
    weight = F.when(j <= period, F.pow(q, m - period)).otherwise(F.pow(q, m - j)) / period
    return F.sum(F.when((i > 1) & (m >= period), value * weight))


def rsi(field: str, period: int = 14) -> Column:
    """Relative strength index."""
    change = F.col(field) - _before(field)
    up, down = _wilder(F.greatest(change, F.lit(0.0)), period), _wilder(F.greatest(-change, F.lit(0.0)), period)
    return F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))


def atr(high: str = "high", low: str = "low", close: str = "close", period: int = 14) -> Column:
    """Average true range; the plain mean below ``period`` ranges."""
    i = F.col("_i")
    ranges = F.when(i > 1, F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - _before(close)), F.abs(F.col(low) - _before(close))))
    return F.coalesce(_wilder(ranges, period), F.avg(ranges))


def keltner(high: str = "high", low: str = "low", close: str = "close", period: int = 20, multiplier: float = 2.0) -> dict[str, Column]:
    """The bands ``upper``, ``middle`` and ``lower``."""
    middle, width = ema(close, period), multiplier * F.coalesce(atr(high, low, close, period), F.lit(0.0))
    return {"upper": middle + width, "middle": middle, "lower": middle - width}


def midpoint(rows: int, high: str = "high", low: str = "low") -> Column:
    """Middle of the range of the last rows, as of the Ichimoku lines."""
    return (F.max(_recent(F.col(high), rows)) + F.min(_recent(F.col(low), rows))) / 2


def _last(field: str) -> Column:
    return F.max(_recent(F.col(field), 1))


def stochastic_k(close: str = "close", high: str = "high", low: str = "low", period: int = 14) -> Column:
    """Place of the last close in the range of ``period`` bars."""
    top, bottom = F.max(_recent(F.col(high), period)), F.min(_recent(F.col(low), period))
    return F.coalesce(F.try_divide(100 * (_last(close) - bottom), top - bottom), F.lit(50.0))


def williams_r(high: str = "high", low: str = "low", close: str = "close", period: int = 14) -> Column:
    """Distance of the last close from the top of the range."""
    top, bottom = F.max(_recent(F.col(high), period)), F.min(_recent(F.col(low), period))
    return F.try_divide(-100 * (top - _last(close)), top - bottom)


def obv(close: str = "close", volume: str = "volume") -> Column:
    """On-balance volume."""
    return F.sum(F.coalesce(F.signum(F.col(close) - _before(close)), F.lit(0.0)) * F.col(volume))


def ha_open(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Open of the last Heikin-Ashi candle."""
    i, n = _place()
    half = F.lit(0.5)
    first = F.when(i == 1, (F.col(open_) + F.col(close)) / 2 * F.pow(half, n - 1)).otherwise(0.0)
    rest = F.when(i < n, (F.col(open_) + F.col(high) + F.col(low) + F.col(close)) / 4 * F.pow(half, n - i)).otherwise(0.0)
    return F.sum(first + rest)


def ha_high(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """High of the last Heikin-Ashi candle."""
    return F.greatest(_last(high), ha_open(open_, high, low, close), (_last(open_) + _last(high) + _last(low) + _last(close)) / 4)


def ha_low(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Low of the last Heikin-Ashi candle."""
    return F.least(_last(low), ha_open(open_, high, low, close), (_last(open_) + _last(high) + _last(low) + _last(close)) / 4)


def _flow(high: str, low: str, close: str, volume: str) -> Column:
    h, l, c = F.col(high), F.col(low), F.col(close)  # noqa: E741
    return F.coalesce(F.try_divide((c - l) - (h - c), h - l), F.lit(0.0)) * F.col(volume)


def ad_line(high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> Column:
    """Accumulation and distribution."""
    return F.sum(_flow(high, low, close, volume))


def cmf(high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", period: int = 20) -> Column:
    """Chaikin money flow of the last ``period`` bars; 0 without volume."""
    return F.coalesce(F.try_divide(F.sum(_recent(_flow(high, low, close, volume), period)), F.sum(_recent(F.col(volume), period))), F.lit(0.0))


def mfi(high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", period: int = 14) -> Column:
    """Money flow index over the last ``period`` changes; null for one bar, 100 without negative flow."""
    price, before = (F.col(high) + F.col(low) + F.col(close)) / 3, (_before(high) + _before(low) + _before(close)) / 3
    flow = _recent(price * F.col(volume), period)
    up, down = (F.coalesce(F.sum(F.when(c, flow)), F.lit(0.0)) for c in (price > before, price < before))
    return F.when(F.max("_n") >= 2, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))))


#: Periods after which Wilder's smoothing has forgotten what was before, to the last bit of a double.
_MEMORY = 38


def _tail_of(directional, high: str, low: str, close: str, ts: str, period: int) -> Column:
    rows = 2 * _MEMORY * max(period, 1)  # one memory for the sums, one for the mean of the index
    h, l, c = (_recent(F.col(f), rows) for f in (high, low, close))  # noqa: E741
    return directional(h, l, c, ts, period)


def adx(high: str = "high", low: str = "low", close: str = "close", ts: str = "ts", period: int = 14) -> Column:
    """Wilder's average directional index, from as many of the last rows as can matter."""
    return _tail_of(trend.adx, high, low, close, ts, period)


def plus_di(high: str = "high", low: str = "low", close: str = "close", ts: str = "ts", period: int = 14) -> Column:
    """Share of upward movement in the true range."""
    return _tail_of(trend.plus_di, high, low, close, ts, period)


def minus_di(high: str = "high", low: str = "low", close: str = "close", ts: str = "ts", period: int = 14) -> Column:
    """Share of downward movement in the true range."""
    return _tail_of(trend.minus_di, high, low, close, ts, period)


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def momentum_score(field: str, ts: str = "ts", period_days: int = 252) -> Column:
    """Return since the first row within ``period_days`` calendar days of the last; null below two rows or if it is 0."""
    near = _micros(F.col(ts)) >= _micros(F.col("_e")) - period_days * DAY
    first, last = F.min_by(field, F.when(near, F.col("_i"))), F.max_by(field, "_i")
    return F.when(F.max("_n") >= 2, F.try_divide(last - first, first))


def adf_test_stat(field: str) -> Column:
    """t of the level before in a regression of the changes on it; null below 10 rows, for a constant series and for one without residual."""
    level = _before(field)
    change = F.col(field) - level
    xx, xy, yy, n = F.regr_sxx(change, level), F.regr_sxy(change, level), F.regr_syy(change, level), F.count(change)
    beta = F.try_divide(xy, xx)
    rest = yy - beta * xy
    return F.when(F.max("_n") >= 10, beta / F.sqrt(F.when((rest > 0) & (xx > 0), rest / (n - 2) / xx)))


def drawdowns(df: DataFrame, keys: Sequence[str], ts: str, price: str, slot: Column | None = None) -> DataFrame:
    """``(keys, max_drawdown, drawdown_duration)``: the worst fall from a peak, and the longest time from a peak to its recovery or the end in whole days.

    Both are null below two rows. Rows with a null time or price do not count, equal times follow
    the price. Peaks are running values; the time below a peak is counted by peaks, of which there is one row each.
    """
    order = [ts, price]
    rows = df.select(*keys, ts, F.col(price).cast("double").alias(price)).dropna(subset=order)
    ran = scan(rows, keys, order, day(ts) if slot is None else slot, greatest={"_was": F.col(price)}, last={"_before": F.col(price)}, total={"_r": F.lit(1)}, before=True)
    peak, t = F.greatest("_was", price), _micros(F.col(ts))
    down = F.col(price) < F.col("_was")
    recovers = ~down & (F.col("_before") < F.col("_was"))
    # what each row tells of a peak: since when it has been, and until when there was less
    tells = F.array(
        F.struct(peak.alias("_p"), t.alias("_since"), F.when(down, t).alias("_until")),
        F.struct(F.when(recovers, F.col("_was")).alias("_p"), F.lit(None).cast("bigint").alias("_since"), t.alias("_until")),
    )
    fall = F.when(peak > 0, (F.col(price) - peak) / peak)
    told = ran.select(*keys, fall.alias("_fall"), F.inline(tells)).where("_p IS NOT NULL")
    peaks = told.groupBy(*keys, "_p").agg(F.min("_since").alias("_since"), F.max("_until").alias("_until"), F.min("_fall").alias("_fall"), F.count("_since").alias("_n"))
    by = peaks.groupBy(*keys).agg(F.least(F.lit(0.0), F.min("_fall")).alias("_d"), F.coalesce(F.max(F.floor((F.col("_until") - F.col("_since")) / DAY)), F.lit(0)).alias("_t"), F.sum("_n").alias("_n"))
    two = F.col("_n") >= 2
    return by.select(*keys, F.when(two, F.col("_d")).alias("max_drawdown"), F.when(two, F.col("_t")).cast("bigint").alias("drawdown_duration"))


def calmar(df: DataFrame, keys: Sequence[str], ts: str, ret: str, close: str, slot: Column | None = None) -> DataFrame:
    """``(keys, calmar_ratio)``: annual return by worst fall; infinite without a fall, null below two rows."""
    order = [ts, ret, close]
    rows = df.select(*keys, ts, *[F.col(c).cast("double").alias(c) for c in (ret, close)]).dropna(subset=order)
    ran = scan(rows, keys, order, day(ts) if slot is None else slot, greatest={"_peak": F.col(close)})
    by = ran.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(ret).alias("_s"), F.max(F.try_divide(F.col("_peak") - F.col(close), F.col("_peak"))).alias("_d"), F.min(_micros(F.col(ts))).alias("_a"), F.max(_micros(F.col(ts))).alias("_z"))
    days = F.floor((F.col("_z") - F.col("_a")) / DAY)
    year = F.when(days > 0, F.col("_s") * YEAR / days).otherwise(0.0)
    return by.select(*keys, F.when(F.col("_n") >= 2, F.when(F.col("_d") > 0, year / F.col("_d")).otherwise(F.lit(INF))).alias("calmar_ratio"))


def hurst(df: DataFrame, keys: Sequence[str], ts: str, value: str, slot: Column | None = None) -> DataFrame:
    """``(keys, hurst_exponent)``: the slope of the mean rescaled range by the length of chunks 8, 16, ... on logarithmic scales.

    Null below 64 rows or if chunks of fewer than three lengths have variance. A row goes to one
    chunk of each length; chunks are sums, least and greatest of running sums, combined before the
    shuffle.
    """
    rows = prepare(df, keys, ts, [value], slot)
    start = scan(rows.select(*keys, ts, "_i", "_n", value), keys, [ts, value, "_i"], day(ts) if slot is None else slot, total={"_y": F.col(value)})
    least = F.floor(F.log2(F.col("_n") + 0.5)).cast("int") - 1
    lengths = F.when(F.col("_n") >= 64, F.sequence(F.lit(3), least))
    each = start.select(*keys, F.explode(F.array_union(F.coalesce(lengths, F.array()), F.array(F.lit(0)))).alias("_k"), "_i", "_n", "_y", value)
    size = F.pow(F.lit(2.0), "_k").cast("bigint")
    each = each.withColumn("_c", F.when(F.col("_k") > 0, F.floor((F.col("_i") - 1) / size)).otherwise(0)).where((F.col("_k") == 0) | (F.col("_c") < F.floor(F.col("_n") / size)))
    chunk = [*keys, "_k", "_c"]
    of = {c: f"_of{i}" for i, c in enumerate(chunk)}
    means = each.where("_k > 0").groupBy(*[F.col(c).alias(n) for c, n in of.items()]).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"))
    on = F.lit(True)
    for c, n in of.items():
        on &= F.col(c).eqNullSafe(F.col(n))
    level = F.col("_y") - F.col("_i") * F.col("_m")
    known = each.join(means, on, "left").select(*chunk, level.alias("_l"), "_sd")
    ranges = known.groupBy(*chunk).agg((F.max("_l") - F.min("_l")).alias("_range"), F.max("_sd").alias("_sd"))
    points = ranges.groupBy(*keys, "_k").agg(F.avg(F.when(F.col("_sd") > 0, F.col("_range") / F.col("_sd"))).alias("_rs"))
    y = F.when(F.col("_k") > 0, F.ln("_rs"))
    return points.groupBy(*keys).agg(F.when(F.count(y) >= 3, F.regr_slope(y, F.col("_k") * math.log(2.0))).alias("hurst_exponent"))
