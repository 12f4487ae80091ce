"""SQL text of the scalar functions, for registration under their names.

``SCALARS`` gives per function its typed parameters, its type and its body.
"""

from __future__ import annotations

import math

# The approximation 7.1.26 of the error function, as in ``pricing``.
_ERF = "(1 - (((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}) / 2))"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / {math.sqrt(2)!r}))"
    erf = _ERF.format(t=t, x=x)
    return f"(CASE WHEN {x} > 6 THEN 1.0 WHEN {x} < -6 THEN 0.0 WHEN {x} < 0 THEN 0.5 * (1 - {erf}) ELSE 0.5 * (1 + {erf}) END)"


def _pdf(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) / {math.sqrt(2 * math.pi)!r})"


#: d1 and d2 stand for themselves in the bodies below.
D1 = "((ln(s / k) + (r + 0.5 * v * v) * t) / (v * sqrt(t)))"
D2 = "(d1 - v * sqrt(t))"
_LOW = "(k * exp(-r * t))"
_OPTION = "s DOUBLE, k DOUBLE, t DOUBLE, r DOUBLE, v DOUBLE"
_CANDLE = "o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE"
_STAR = "o1 DOUBLE, c1 DOUBLE, o2 DOUBLE, c2 DOUBLE, o3 DOUBLE, c3 DOUBLE"
_PP = "((h + l + c) / 3)"


def _priced(body: str) -> tuple[str, str, str]:
    bound = f"get(transform(array({D1}), d1 -> get(transform(array({D2}), d2 -> {body}), 0)), 0)"
    return _OPTION, "DOUBLE", f"CASE WHEN s > 0 AND k > 0 AND t > 0 AND v > 0 THEN {bound} END"


def _known(parameters: str, body: str) -> str:
    names = [p.split()[0] for p in parameters.split(", ")]
    return f"CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in names)} THEN {body} END"


def _pivot(body: str) -> tuple[str, str, str]:
    return "h DOUBLE, l DOUBLE, c DOUBLE", "DOUBLE", body


SCALARS: dict[str, tuple[str, str, str]] = {
    "pivot_point": _pivot(_PP),
    "pivot_r1": _pivot(f"2 * {_PP} - l"),
    "pivot_r2": _pivot(f"{_PP} + (h - l)"),
    "pivot_r3": _pivot(f"h + 2 * ({_PP} - l)"),
    "pivot_s1": _pivot(f"2 * {_PP} - h"),
    "pivot_s2": _pivot(f"{_PP} - (h - l)"),
    "pivot_s3": _pivot(f"l - 2 * (h - {_PP})"),
    "simple_return": ("c DOUBLE, p DOUBLE", "DOUBLE", "CASE WHEN p = 0 AND c IS NOT NULL THEN 0.0 ELSE (c - p) / nullif(p, 0) END"),
    "log_return": ("c DOUBLE, p DOUBLE", "DOUBLE", _known("c DOUBLE, p DOUBLE", "CASE WHEN c > 0 AND p > 0 THEN ln(c / p) ELSE 0.0 END")),
    "pct_change": ("c DOUBLE, p DOUBLE", "DOUBLE", "(c - p) / nullif(p, 0)"),
    "safe_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / nullif(b, 0)"),
    "clip": ("x DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "greatest(lo, least(hi, x))"),
    "zscore": ("x DOUBLE, m DOUBLE, d DOUBLE", "DOUBLE", "(x - m) / nullif(d, 0)"),
    "pct_to_bps": ("p DOUBLE", "DOUBLE", "p * 10000"),
    "bps_to_pct": ("b DOUBLE", "DOUBLE", "b / 10000.0"),
    "ma_crossover_signal": ("f DOUBLE, s DOUBLE", "STRING", _known("f DOUBLE, s DOUBLE", "CASE WHEN f > s THEN 'BUY' WHEN f < s THEN 'SELL' ELSE 'HOLD' END")),
    "rsi_signal": ("r DOUBLE, top DOUBLE DEFAULT 70, bottom DOUBLE DEFAULT 30", "STRING", _known("r DOUBLE, top DOUBLE, bottom DOUBLE", "CASE WHEN r >= top THEN 'SELL' WHEN r <= bottom THEN 'BUY' ELSE 'HOLD' END")),
    "bollinger_signal": ("c DOUBLE, u DOUBLE, l DOUBLE", "STRING", _known("c DOUBLE, u DOUBLE, l DOUBLE", "CASE WHEN c > u THEN 'SELL' WHEN c < l THEN 'BUY' ELSE 'HOLD' END")),
    "kelly_fraction": (
        "p DOUBLE, w DOUBLE, l DOUBLE", "DOUBLE",
        _known("p DOUBLE, w DOUBLE, l DOUBLE", "CASE WHEN l = 0 OR p < 0 OR p > 1 THEN 0.0 WHEN w = 0 THEN CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, (p * w / nullif(abs(l), 0) - (1 - p)) / nullif(w / nullif(abs(l), 0), 0))) END"),
    ),
    "composite_score": (
        "r DOUBLE, m DOUBLE, b DOUBLE, o DOUBLE", "DOUBLE",
        _known("r DOUBLE, m DOUBLE, b DOUBLE, o DOUBLE", "greatest(-25.0, least(25.0, 50 - r)) + CASE WHEN m > 0 THEN 1 ELSE -1 END * least(abs(m) * 10, 25.0) + greatest(-25.0, least(25.0, (0.5 - b) * 50)) + greatest(-25.0, least(25.0, o * 25))"),
    ),
    "is_doji": (f"{_CANDLE}, threshold DOUBLE DEFAULT 0.05", "BOOLEAN", _known(_CANDLE, "CASE WHEN h = l THEN true ELSE abs(c - o) / nullif(h - l, 0) < threshold END")),
    "is_hammer": (_CANDLE, "BOOLEAN", _known(_CANDLE, "h > l AND abs(c - o) > 0 AND least(o, c) - l >= 2 * abs(c - o) AND h - greatest(o, c) <= 0.1 * (h - l)")),
    "is_shooting_star": (_CANDLE, "BOOLEAN", _known(_CANDLE, "h > l AND abs(c - o) > 0 AND h - greatest(o, c) >= 2 * abs(c - o) AND least(o, c) - l <= 0.1 * (h - l)")),
    "is_engulfing": (f"{_CANDLE}, po DOUBLE, pc DOUBLE", "STRING", "CASE WHEN pc < po AND c > o AND o <= pc AND c >= po THEN 'BULLISH' WHEN pc > po AND c < o AND o >= pc AND c <= po THEN 'BEARISH' END"),
    "is_morning_star": (_STAR, "BOOLEAN", _known(_STAR, "c1 < o1 AND abs(c2 - o2) < abs(c1 - o1) * 0.5 AND greatest(o2, c2) < c1 AND c3 > o3 AND c3 > (o1 + c1) / 2")),
    "is_evening_star": (_STAR, "BOOLEAN", _known(_STAR, "c1 > o1 AND abs(c2 - o2) < abs(c1 - o1) * 0.5 AND least(o2, c2) > c1 AND c3 < o3 AND c3 < (o1 + c1) / 2")),
}

#: Prices and sensitivities of options in terms of d1 and d2.
OPTIONS: dict[str, str] = {
    "bs_call": f"s * {_cdf('d1')} - {_LOW} * {_cdf('d2')}",
    "bs_put": f"{_LOW} * {_cdf('(-d2)')} - s * {_cdf('(-d1)')}",
    "bs_delta_call": _cdf("d1"),
    "bs_delta_put": f"{_cdf('d1')} - 1",
    "bs_gamma": f"{_pdf('d1')} / (s * v * sqrt(t))",
    "bs_theta_call": f"(-s * {_pdf('d1')} * v / (2 * sqrt(t)) - r * {_LOW} * {_cdf('d2')}) / 365",
    "bs_theta_put": f"(-s * {_pdf('d1')} * v / (2 * sqrt(t)) + r * {_LOW} * {_cdf('(-d2)')}) / 365",
    "bs_vega": f"s * {_pdf('d1')} * sqrt(t) / 100",
}
SCALARS |= {name: _priced(body) for name, body in OPTIONS.items()}


_BOND = "f DOUBLE, c DOUBLE, y DOUBLE, n INT, q DOUBLE"
_STEPS = "sequence(1, CASE WHEN n > 0 AND q > 0 THEN n END)"
_BASE = "(1 + y / nullif(q, 0))"


def _sum(power: str, factor: str) -> str:
    return f"aggregate({_STEPS}, CAST(0 AS DOUBLE), (a, i) -> a + {factor} * (f * c / nullif(q, 0) + CASE WHEN i = n THEN f ELSE 0 END) / power({_BASE}, {power}))"


_PRICE = _sum("i", "1")
#: Bond functions; their sums are Spark's higher-order functions.
BONDS: dict[str, tuple[str, str, str]] = {
    "bond_price": (_BOND, "DOUBLE", _PRICE),
    "bond_macaulay_duration": (_BOND, "DOUBLE", f"CASE WHEN {_PRICE} > 0 THEN {_sum('i', 'i')} / {_PRICE} / q END"),
    "bond_modified_duration": (_BOND, "DOUBLE", f"CASE WHEN {_PRICE} > 0 THEN {_sum('i', 'i')} / {_PRICE} / q / {_BASE} END"),
    "bond_convexity": (_BOND, "DOUBLE", f"CASE WHEN {_PRICE} > 0 THEN {_sum('(i + 2)', 'i * (i + 1)')} / {_PRICE} / (q * q) END"),
}
