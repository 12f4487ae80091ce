"""Pivot points, returns, signals, candlestick patterns and small helpers as column expressions.

A null in any argument gives null, but for ``clip``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.series import ColumnOrName, column, complete, number

Value = ColumnOrName | float


def timebucket(ts: ColumnOrName, width_micros: int) -> Column:
    """``ts`` down to a multiple of the width from the epoch; before the epoch up. The type of ``ts`` stays if it is ``timestamp``."""
    micros = F.unix_micros(column(ts).cast("timestamp"))
    return F.timestamp_micros(micros - micros % F.lit(width_micros))


def pivot_point(high: Value, low: Value, close: Value) -> Column:
    return (number(high) + number(low) + number(close)) / 3


def pivot_r1(high: Value, low: Value, close: Value) -> Column:
    return 2 * pivot_point(high, low, close) - number(low)


def pivot_r2(high: Value, low: Value, close: Value) -> Column:
    return pivot_point(high, low, close) + (number(high) - number(low))


def pivot_r3(high: Value, low: Value, close: Value) -> Column:
    return number(high) + 2 * (pivot_point(high, low, close) - number(low))


def pivot_s1(high: Value, low: Value, close: Value) -> Column:
    return 2 * pivot_point(high, low, close) - number(high)


def pivot_s2(high: Value, low: Value, close: Value) -> Column:
    return pivot_point(high, low, close) - (number(high) - number(low))


def pivot_s3(high: Value, low: Value, close: Value) -> Column:
    return number(low) - 2 * (number(high) - pivot_point(high, low, close))


def simple_return(current: Value, previous: Value) -> Column:
    """Relative change; 0 from 0."""
    c, p = number(current), number(previous)
    return complete(F.when(p == 0, 0.0).otherwise((c - p) / F.nullif(p, F.lit(0.0))), c, p)


def log_return(current: Value, previous: Value) -> Column:
    """Logarithm of the ratio; 0 unless both are above 0."""
    c, p = number(current), number(previous)
    return complete(F.when((c > 0) & (p > 0), F.ln(c / p)).otherwise(0.0), c, p)


def pct_change(current: Value, previous: Value) -> Column:
    """Relative change; null from 0."""
    return F.try_divide(number(current) - number(previous), number(previous))


def safe_div(a: Value, b: Value) -> Column:
    """Quotient; null for a divisor of 0."""
    return F.try_divide(number(a), number(b))


def clip(x: Value, low: Value, high: Value) -> Column:
    """``x`` within its limits; nulls among the three are skipped."""
    return F.greatest(number(low), F.least(number(high), number(x)))


def zscore(x: Value, mean: Value, deviation: Value) -> Column:
    """Distance from the mean in deviations; null for a deviation of 0."""
    return F.try_divide(number(x) - number(mean), number(deviation))


def pct_to_bps(p: Value) -> Column:
    return number(p) * 10000


def bps_to_pct(b: Value) -> Column:
    return number(b) / 10000


def ma_crossover_signal(fast: Value, slow: Value) -> Column:
    """BUY above, SELL below, else HOLD."""
    f, s = number(fast), number(slow)
    return complete(F.when(f > s, "BUY").when(f < s, "SELL").otherwise("HOLD"), f, s)


def rsi_signal(rsi: Value, overbought: Value = 70.0, oversold: Value = 30.0) -> Column:
    """SELL from ``overbought`` on, BUY down from ``oversold``, else HOLD."""
    r, top, bottom = number(rsi), number(overbought), number(oversold)
    return complete(F.when(r >= top, "SELL").when(r <= bottom, "BUY").otherwise("HOLD"), r, top, bottom)


def bollinger_signal(close: Value, upper: Value, lower: Value) -> Column:
    """SELL above the upper band, BUY below the lower, else HOLD."""
    c, u, l = number(close), number(upper), number(lower)  # noqa: E741
    return complete(F.when(c > u, "SELL").when(c < l, "BUY").otherwise("HOLD"), c, u, l)


def kelly_fraction(win_rate: Value, avg_win: Value, avg_loss: Value) -> Column:
    """Share to stake, from 0 to 1; 0 without losses or for a rate outside 0 to 1."""
    p, w, l = number(win_rate), number(avg_win), number(avg_loss)  # noqa: E741
    b = w / F.nullif(F.abs(l), F.lit(0.0))
    share = F.when(b == 0, F.when(p == 1, 1.0).otherwise(0.0)).otherwise((p * b - (1 - p)) / F.nullif(b, F.lit(0.0)))
    return complete(F.when((l == 0) | (p < 0) | (p > 1), 0.0).otherwise(clip(share, 0.0, 1.0)), p, w, l)


def composite_score(rsi: Value, macd: Value, bb_pct: Value, obv_pct: Value) -> Column:
    """Sum of four parts, each from -25 to 25; above 0 is bullish."""
    r, m, b, o = number(rsi), number(macd), number(bb_pct), number(obv_pct)
    parts = clip(50 - r, -25.0, 25.0) + F.when(m > 0, 1.0).otherwise(-1.0) * F.least(F.abs(m) * 10, F.lit(25.0)) + clip((0.5 - b) * 50, -25.0, 25.0) + clip(o * 25, -25.0, 25.0)
    return complete(parts, r, m, b, o)


def is_doji(open_: Value, high: Value, low: Value, close: Value, threshold: float = 0.05) -> Column:
    """The body is less than ``threshold`` of the range; true without range."""
    o, h, l, c = map(number, (open_, high, low, close))  # noqa: E741
    return complete(F.coalesce(F.try_divide(F.abs(c - o), h - l) < threshold, F.lit(True)), o, h, l, c)


def _wicks(open_, high, low, close, flip: bool) -> Column:
    o, h, l, c = map(number, (open_, high, low, close))  # noqa: E741
    upper, lower, body = h - F.greatest(o, c), F.least(o, c) - l, F.abs(c - o)
    long, short = (upper, lower) if flip else (lower, upper)
    return complete((h > l) & (body > 0) & (long >= 2 * body) & (short <= 0.1 * (h - l)), o, h, l, c)


def is_hammer(open_: Value, high: Value, low: Value, close: Value) -> Column:
    """A long lower wick below a small body."""
    return _wicks(open_, high, low, close, False)


def is_shooting_star(open_: Value, high: Value, low: Value, close: Value) -> Column:
    """A long upper wick above a small body."""
    return _wicks(open_, high, low, close, True)


def is_engulfing(open_: Value, high: Value, low: Value, close: Value, previous_open: Value, previous_close: Value) -> Column:
    """BULLISH or BEARISH where the body encloses an opposite one before it, else null."""
    o, c, po, pc = map(number, (open_, close, previous_open, previous_close))
    return F.when((pc < po) & (c > o) & (o <= pc) & (c >= po), "BULLISH").when((pc > po) & (c < o) & (o >= pc) & (c <= po), "BEARISH")


def is_morning_star(o1: Value, c1: Value, o2: Value, c2: Value, o3: Value, c3: Value) -> Column:
    """A fall, a small body below it and a rise beyond the middle of the fall."""
    a, b, c, d, e, f = map(number, (o1, c1, o2, c2, o3, c3))
    return complete((b < a) & (F.abs(d - c) < F.abs(b - a) * 0.5) & (F.greatest(c, d) < b) & (f > e) & (f > (a + b) / 2), a, b, c, d, e, f)


def is_evening_star(o1: Value, c1: Value, o2: Value, c2: Value, o3: Value, c3: Value) -> Column:
    """A rise, a small body above it and a fall beyond the middle of the rise."""
    a, b, c, d, e, f = map(number, (o1, c1, o2, c2, o3, c3))
    return complete((b > a) & (F.abs(d - c) < F.abs(b - a) * 0.5) & (F.least(c, d) > b) & (f < e) & (f < (a + b) / 2), a, b, c, d, e, f)
