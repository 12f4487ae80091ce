"""One query per scalar function over bars, options and bonds, and SQL for the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import pricing, scalars
from tickloom.functions.texts import D1, D2, SCALARS
from tickloom.functions.texts import OPTIONS as OPTION_TEXTS
from tickloom.plans.views import BARS, BONDS, OPTIONS, bars, bonds, candles, options, ticks

#: Functions over bars with the names of their arguments.
_BARS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("pivot_point", "pivot_r1", "pivot_r2", "pivot_r3", "pivot_s1", "pivot_s2", "pivot_s3"), ("high", "low", "close")),
    **dict.fromkeys(("simple_return", "log_return", "pct_change"), ("close", "close1")),
    "safe_div": ("close", "low"),
    "clip": ("close", "low1", "high1"),
    "zscore": ("close", "open", "volume"),
    "pct_to_bps": ("close",),
    "bps_to_pct": ("close",),
    "ma_crossover_signal": ("close", "close1"),
    "rsi_signal": ("volume",),
    "bollinger_signal": ("close", "open1", "close1"),
    **dict.fromkeys(("is_doji", "is_hammer", "is_shooting_star"), ("open", "high", "low", "close")),
    "is_engulfing": ("open", "high", "low", "close", "open1", "close1"),
    **dict.fromkeys(("is_morning_star", "is_evening_star"), ("open2", "close2", "open1", "close1", "open", "close")),
}
#: Arguments that are expressions, alike in both dialects.
_MADE: dict[str, tuple[str, ...]] = {"kelly_fraction": ("low / high", "high", "close"), "composite_score": ("100 * low / high", "close - open", "low / high", "(close - open) / high")}
_OPTIONS = ("bs_call", "bs_put", "bs_delta_call", "bs_delta_put", "bs_gamma", "bs_theta_call", "bs_theta_put", "bs_vega")


def _rounded(name: str, value: Column) -> Column:
    return F.round(value, 6) if SCALARS[name][1] == "DOUBLE" else value


def _on_bars(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = candles(spark, sf)
        if any(a in ("low1", "high1") for a in _BARS.get(name, ())):
            w = Window.partitionBy("symbol").orderBy("ts")
            rows = rows.withColumns({"low1": F.lag("low").over(w), "high1": F.lag("high").over(w)})
        arguments = _BARS.get(name) or [F.expr(x) for x in _MADE[name]]
        return rows.select("symbol", "bar_us", _rounded(name, getattr(scalars, name)(*arguments)).alias(name))

    return query


def _on_options(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: options(spark, sf).select("p_partkey", F.round(getattr(pricing, name)("s", "k", "t", "r", "v"), 6).alias(name))


def _on_bonds(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: bonds(spark, sf).select("p_partkey", F.round(getattr(pricing, name)("f", "c", "y", "n", "q"), 6).alias(name))


def timebucket(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks counted by buckets of five minutes."""
    by = ticks(spark, sf).groupBy(F.unix_micros(scalars.timebucket("ts", 300_000_000)).alias("bucket_us"))
    return by.agg(F.count("*").alias("n"))


def bs_implied_vol(spark: SparkSession, sf: str) -> DataFrame:
    """Calls priced again at the volatility found from their price, which far from the money is not unique."""
    grid = options(spark, sf).withColumn("price", pricing.bs_call("s", "k", "t", "r", "v"))
    found = grid.withColumn("found", pricing.bs_implied_vol("price", "s", "k", "t", "r", F.lit(True)))
    return found.select("p_partkey", F.round(pricing.bs_call("s", "k", "t", "r", "found"), 4).alias("price"))


def bond_ytm(spark: SparkSession, sf: str) -> DataFrame:
    """Yields found again from prices."""
    grid = bonds(spark, sf).withColumn("price", pricing.bond_price("f", "c", "y", "n", "q"))
    return grid.select("p_partkey", F.round(pricing.bond_ytm("price", "f", "c", "n", "q"), 6).alias("bond_ytm"))


def am_call(spark: SparkSession, sf: str) -> DataFrame:
    return options(spark, sf).select("p_partkey", F.round(pricing.am_call("s", "k", "t", "r", "v"), 6).alias("am_call"))


def am_put(spark: SparkSession, sf: str) -> DataFrame:
    return options(spark, sf).select("p_partkey", F.round(pricing.am_put("s", "k", "t", "r", "v"), 6).alias("am_put"))


_FLOWS = ("bond_price", "bond_macaulay_duration", "bond_modified_duration", "bond_convexity")
QUERIES = (
    {name: _on_bars(name) for name in (*_BARS, *_MADE)}
    | {name: _on_options(name) for name in _OPTIONS}
    | {name: _on_bonds(name) for name in _FLOWS}
    | {"timebucket": timebucket, "bs_implied_vol": bs_implied_vol, "bond_ytm": bond_ytm, "am_call": am_call, "am_put": am_put}
)


def _called(name: str, arguments: tuple[str, ...]) -> str:
    """The body of a scalar function with its arguments in place of the parameters."""
    parameters, kind, body = SCALARS[name]
    given: dict[str, str] = {}
    for k, p in enumerate(parameters.split(", ")):
        given[p.split()[0]] = f"({arguments[k]})" if k < len(arguments) else p.rpartition("DEFAULT ")[2]
    text = re.sub(r"\b[a-z]\w*\b(?!\()", lambda m: given.get(m[0], m[0]), body)
    return f"round(CAST({text} AS DOUBLE), 6) + 0.0" if kind == "DOUBLE" else text


def _option(name: str) -> str:
    return re.sub(r"\bd1\b", D1, re.sub(r"\bd2\b", D2, OPTION_TEXTS[name]))


def _bond(power: str, factor: str) -> str:
    return f"list_sum(list_transform(range(1, n + 1), lambda i: {factor} * (f * c / q + CASE WHEN i = n THEN f ELSE 0 END) / power(1 + y / q, {power})))"


_PRICE = _bond("i", "1")
_BOND_SQL = {
    "bond_price": _PRICE,
    "bond_macaulay_duration": f"{_bond('i', 'i')} / {_PRICE} / q",
    "bond_modified_duration": f"{_bond('i', 'i')} / {_PRICE} / q / (1 + y / q)",
    "bond_convexity": f"{_bond('i + 2', 'i * (i + 1)')} / {_PRICE} / (q * q)",
    "bond_ytm": "y",
}


def _tree(sign: int, name: str, steps: int = 200) -> str:
    """A binomial tree from its leaves down, one list of values for each step."""
    gain = lambda n, j: f"{sign} * (s * power(u, {n} - 2 * {j}) - k)"
    return f"""WITH RECURSIVE {OPTIONS}, d AS (SELECT *, t / {steps} AS dt, exp(v * sqrt(t / {steps})) AS u FROM o), c AS (SELECT *, (exp(r * dt) - 1 / u) / (u - 1 / u) AS p FROM d),
tree AS (SELECT p_partkey, {steps} AS n, list_transform(range(0, {steps + 1}), lambda j: greatest({gain(steps, "j")}, 0)) AS x FROM c WHERE p > 0 AND p < 1
 UNION ALL SELECT p_partkey, n - 1, list_transform(range(0, n), lambda j: greatest(exp(-r * dt) * (p * x[j + 1] + (1 - p) * x[j + 2]), {gain("n - 1", "j")})) FROM tree JOIN c USING (p_partkey) WHERE n > 0)
SELECT p_partkey, round(x[1], 6) + 0.0 AS {name} FROM c LEFT JOIN (SELECT * FROM tree WHERE n = 0) AS l USING (p_partkey)"""


ORACLE = (
    {name: f"WITH {BARS} SELECT symbol, bar_us, {_called(name, a)} AS {name} FROM b" for name, a in (_BARS | _MADE).items()}
    | {name: f"WITH {OPTIONS} SELECT p_partkey, round({_option(name)}, 6) + 0.0 AS {name} FROM o" for name in _OPTIONS}
    | {name: f"WITH {BONDS} SELECT p_partkey, round({e}, 6) AS {name} FROM g" for name, e in _BOND_SQL.items()}
    | {
        "timebucket": "SELECT epoch_us(ts) - epoch_us(ts) % 300000000 AS bucket_us, count(*) AS n FROM events GROUP BY ALL",
        "bs_implied_vol": f"WITH {OPTIONS} SELECT p_partkey, round({_option('bs_call')}, 4) + 0.0 AS price FROM o",
    }
    | {f"am_{kind}": _tree(sign, f"am_{kind}") for kind, sign in (("call", 1), ("put", -1))}
)
