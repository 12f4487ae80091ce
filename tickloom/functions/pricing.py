"""Option and bond prices as column expressions, with vectorized kernels where iteration is needed.

A null argument gives null, and so does one outside the domain of the formula.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tickloom.functions.series import ColumnOrName, column, complete, let, number

Value = ColumnOrName | float
# The rational approximation 7.1.26 of the error function by Abramowitz and Stegun.
_SCALE = 0.3275911
_TERMS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _polynomial(t):
    total = 0.0
    for a in reversed(_TERMS):
        total = (total + a) * t
    return total


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, 0 and 1 beyond six deviations."""
    erf = let(1 / (1 + _SCALE * F.abs(x) / math.sqrt(2)), lambda t: 1 - _polynomial(t) * F.exp(-x * x / 2))
    return F.when(x > 6, 1.0).when(x < -6, 0.0).otherwise(0.5 * (1 + F.signum(x) * erf))


def norm_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def _black_scholes(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value, formula: Callable[..., Column]) -> Column:
    s, k, t, r, v = map(number, (spot, strike, years, rate, sigma))
    valid = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    # outside the domain the formula sees ones, which keeps divisions and logarithms sound
    s, k, t, v = (F.when(valid, x).otherwise(1.0) for x in (s, k, t, v))
    d1 = (F.ln(s / k) + (r + 0.5 * v * v) * t) / (v * F.sqrt(t))
    return F.when(valid, let(d1, lambda d: let(d - v * F.sqrt(t), lambda e: formula(s, k, t, r, v, d, e))))


def bs_call(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: s * norm_cdf(d1) - k * F.exp(-r * t) * norm_cdf(d2))


def bs_put(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: k * F.exp(-r * t) * norm_cdf(-d2) - s * norm_cdf(-d1))


def bs_delta_call(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: norm_cdf(d1))


def bs_delta_put(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    return bs_delta_call(spot, strike, years, rate, sigma) - 1


def bs_gamma(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: norm_pdf(d1) / (s * v * F.sqrt(t)))


def bs_theta_call(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    """Per calendar day."""
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: (-s * norm_pdf(d1) * v / (2 * F.sqrt(t)) - r * k * F.exp(-r * t) * norm_cdf(d2)) / 365)


def bs_theta_put(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    """Per calendar day."""
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: (-s * norm_pdf(d1) * v / (2 * F.sqrt(t)) + r * k * F.exp(-r * t) * norm_cdf(-d2)) / 365)


def bs_vega(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value) -> Column:
    """Per point of volatility in percent."""
    return _black_scholes(spot, strike, years, rate, sigma, lambda s, k, t, r, v, d1, d2: s * norm_pdf(d1) * F.sqrt(t) / 100)


# Fixed values, on which the results of searches depend: their most steps; the start of volatilities, their
# least vega and error, and what takes the place of one below 0; the start of yields without a coupon, their
# least error and slope, the least yield, and what takes the place of a lower one.
STEPS = 100
VOLATILITY_START, VOLATILITY_SLOPE, VOLATILITY_ERROR, VOLATILITY_FLOOR = 0.3, 1e-12, 1e-8, 0.001
YIELD_START, YIELD_ERROR, YIELD_SLOPE, YIELD_LEAST, YIELD_FLOOR = 0.05, 1e-9, 1e-14, -0.999, -0.99


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2)
    erf = 1 - _polynomial(1 / (1 + _SCALE * z)) * np.exp(-z * z)
    return np.where(x > 6, 1.0, np.where(x < -6, 0.0, 0.5 * (1 + np.where(x < 0, -erf, erf))))


@pandas_udf(DoubleType())
def _implied_vol(price: pd.Series, spot: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
    p, s, k, t, r = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, spot, strike, years, rate))
    is_call = call.to_numpy(dtype=bool, na_value=False)
    sigma = np.full(len(p), VOLATILITY_START)
    live = np.flatnonzero((s > 0) & (k > 0) & (t > 0))
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            if not len(live):
                break
            a, b, c, d, v = s[live], k[live], t[live], r[live], sigma[live]
            root = np.sqrt(c)
            d1 = (np.log(a / b) + (d + 0.5 * v * v) * c) / (v * root)
            d2, low = d1 - v * root, b * np.exp(-d * c)
            model = np.where(is_call[live], a * _cdf(d1) - low * _cdf(d2), low * _cdf(-d2) - a * _cdf(-d1))
            vega = a * np.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi) * root
            off = model - p[live]
            go = (vega >= VOLATILITY_SLOPE) & (np.abs(off) >= VOLATILITY_ERROR)
            live = live[go]
            moved = v[go] - off[go] / vega[go]
            sigma[live] = np.where(moved <= 0, VOLATILITY_FLOOR, moved)
    return pd.Series(np.where(np.isnan(p) | np.isnan(s), np.nan, sigma))


def bs_implied_vol(price: Value, spot: Value, strike: Value, years: Value, rate: Value, is_call: Column) -> Column:
    """Volatility at which the model gives the price, by Newton's method from 0.3.

    Up to 100 steps, the last estimate standing even if it has not converged; null for a null price or spot.
    """
    values = [number(x) for x in (price, spot, strike, years, rate)]
    found = _implied_vol(*values, column(is_call).cast("boolean"))
    return complete(found, *values[:2])


def _tree(s, k, t, r, v, steps: int, call: bool) -> np.ndarray:
    out = np.full(len(s), np.nan)
    with np.errstate(all="ignore"):
        dt = t / steps
        u = np.exp(v * np.sqrt(dt))
        p = (np.exp(r * dt) - 1 / u) / (u - 1 / u)
        rows = np.flatnonzero((s > 0) & (k > 0) & (t > 0) & (v > 0) & (p > 0) & (p < 1))
    powers = np.arange(steps, -steps - 1, -1)
    sign = 1.0 if call else -1.0
    for some in np.array_split(rows, max(1, len(rows) * steps // 200_000)):
        # gains from exercise at every price of the tree, by the number of moves upwards
        gain = sign * (s[some, None] * u[some, None] ** powers - k[some, None])
        discount = np.exp(-r[some] * dt[some])
        up, down = (discount * p[some])[:, None], (discount * (1 - p[some]))[:, None]
        value = np.maximum(gain[:, ::2], 0)
        for n in range(steps - 1, -1, -1):
            value = np.maximum(up * value[:, :-1] + down * value[:, 1:], gain[:, steps - n : steps + n + 1 : 2])
        out[some] = value[:, 0]
    return out


def _american_kernel(call: bool, steps: int):
    @pandas_udf(DoubleType())
    def price(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(_tree(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (s, k, t, r, v)), steps, call))

    return price


def _american(call: bool, spot, strike, years, rate, sigma, steps: int) -> Column:
    if steps <= 0:
        return F.lit(None).cast("double")
    return _american_kernel(call, steps)(*map(number, (spot, strike, years, rate, sigma)))


def am_call(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value, steps: int = 200) -> Column:
    """American call by a binomial tree; null where the tree has no risk-neutral probability."""
    return _american(True, spot, strike, years, rate, sigma, steps)


def am_put(spot: Value, strike: Value, years: Value, rate: Value, sigma: Value, steps: int = 200) -> Column:
    """American put by a binomial tree; null where the tree has no risk-neutral probability."""
    return _american(False, spot, strike, years, rate, sigma, steps)


def _flows(face: Value, coupon: Value, ytm: Value, periods: Value, freq: Value, term: Callable[[Column, Column], Column]) -> tuple[Column, Column, Column]:
    """Sum of ``term(t, cash flow)`` with the yield per period, as (sum, 1 + yield, frequency)."""
    n = column(periods).cast("int") if not isinstance(periods, (int, float)) else F.lit(int(periods))
    f, c, y, q = map(number, (face, coupon, ytm, freq))
    valid = (n > 0) & (q > 0)
    q = F.when(q > 0, q)
    base = 1 + y / q
    flow = f * c / q
    steps = F.sequence(F.lit(1), F.when(valid, n))
    total = F.aggregate(steps, F.lit(0.0).cast("double"), lambda a, t: a + term(t.cast("double"), flow + F.when(t == n, f).otherwise(0.0)))
    return complete(total, f, c, y), base, q


def bond_price(face: Value, coupon: Value, ytm: Value, periods: Value, freq: Value) -> Column:
    """Present value of the coupons and the face value; null without periods or frequency."""
    base = 1 + number(ytm) / F.nullif(number(freq), F.lit(0.0))
    return _flows(face, coupon, ytm, periods, freq, lambda t, c: c / F.pow(base, t))[0]


def bond_macaulay_duration(face: Value, coupon: Value, ytm: Value, periods: Value, freq: Value) -> Column:
    """Mean time of the payments in years; null unless the price is above 0."""
    price = bond_price(face, coupon, ytm, periods, freq)
    base = 1 + number(ytm) / F.nullif(number(freq), F.lit(0.0))
    total, _, q = _flows(face, coupon, ytm, periods, freq, lambda t, c: t * c / F.pow(base, t))
    return F.when(price > 0, total / price / q)


def bond_modified_duration(face: Value, coupon: Value, ytm: Value, periods: Value, freq: Value) -> Column:
    """Macaulay's duration by one plus the yield per period."""
    return bond_macaulay_duration(face, coupon, ytm, periods, freq) / (1 + number(ytm) / F.nullif(number(freq), F.lit(0.0)))


def bond_convexity(face: Value, coupon: Value, ytm: Value, periods: Value, freq: Value) -> Column:
    """Convexity in years squared; null unless the price is above 0."""
    price = bond_price(face, coupon, ytm, periods, freq)
    base = 1 + number(ytm) / F.nullif(number(freq), F.lit(0.0))
    total, _, q = _flows(face, coupon, ytm, periods, freq, lambda t, c: t * (t + 1) * c / F.pow(base, t + 2))
    return F.when(price > 0, total / price / (q * q))


@pandas_udf(DoubleType())
def _yield(price: pd.Series, face: pd.Series, coupon: pd.Series, periods: pd.Series, freq: pd.Series) -> pd.Series:
    p, f, c, n, q = (x.to_numpy(dtype=float, na_value=np.nan) for x in (price, face, coupon, periods, freq))
    out = np.full(len(p), np.nan)
    valid = np.flatnonzero((p > 0) & (n > 0) & (q > 0) & ~np.isnan(f) & ~np.isnan(c))
    for length in np.unique(n[valid]):
        rows = valid[n[valid] == length]
        t = np.arange(1, int(length) + 1)
        rate = np.where(c[rows] > 0, c[rows], YIELD_START)
        flow = np.repeat((f[rows] * c[rows] / q[rows])[:, None], len(t), axis=1)
        flow[:, -1] += f[rows]
        live = np.arange(len(rows))
        with np.errstate(all="ignore"):
            for _ in range(STEPS):
                if not len(live):
                    break
                base = 1 + rate[live] / q[rows[live]]
                present = flow[live] / base[:, None] ** t
                off = present.sum(axis=1) - p[rows[live]]
                slope = -(present * t).sum(axis=1) / base / q[rows[live]]
                go = (np.abs(off) >= YIELD_ERROR) & (np.abs(slope) >= YIELD_SLOPE)
                live = live[go]
                moved = rate[live] - off[go] / slope[go]
                rate[live] = np.where(moved <= YIELD_LEAST, YIELD_FLOOR, moved)
        out[rows] = rate
    return pd.Series(out)


def bond_ytm(price: Value, face: Value, coupon: Value, periods: Value, freq: Value) -> Column:
    """Yearly yield at which the bond has the price, by Newton's method from the coupon rate."""
    return _yield(*map(number, (price, face, coupon, periods, freq)))


def kernels() -> dict[str, Callable]:
    """The functions that are no expressions, by their names in SQL; trees have 200 steps there."""
    return {"bs_implied_vol": _implied_vol, "bond_ytm": _yield, "am_call": _american_kernel(True, 200), "am_put": _american_kernel(False, 200)}
