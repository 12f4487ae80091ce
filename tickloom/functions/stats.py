"""Statistics of ordered series."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.series import ColumnOrName, fold, let, ordered


def _rescaled_range(chunk: Column) -> Column:
    return let(F.struct(chunk.alias("c"), (_sum(chunk) / F.size(chunk)).alias("m")), lambda x: _range_by_deviation(x["c"], x["m"]))


def _range_by_deviation(chunk: Column, mean: Column) -> Column:
    n = F.size(chunk).cast("double")
    zero, none = F.lit(0.0).cast("double"), F.lit(None).cast("double")
    start = F.struct(zero.alias("y"), none.alias("lo"), none.alias("hi"), zero.alias("s"))

    def step(a: Column, v: Column) -> Column:
        y = a["y"] + v - mean
        return F.struct(y.alias("y"), F.least(a["lo"], y).alias("lo"), F.greatest(a["hi"], y).alias("hi"), (a["s"] + (v - mean) * (v - mean)).alias("s"))

    return F.aggregate(chunk, start, step, lambda a: F.when(a["s"] > 0, (a["hi"] - a["lo"]) / F.sqrt(a["s"] / n)))


def hurst_exponent(value: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """Hurst's exponent: slope of the mean rescaled range by the length of chunks 8, 16, ... on logarithmic scales.

    Null unless chunks of at least three lengths fit twice, that is below 64 rows, or have variance.
    """
    return let(F.transform(ordered(ts, over, v=value), lambda x: x["v"]), lambda values: F.when(F.size(values) >= 64, _hurst(values)))


def _hurst(values: Column) -> Column:
    n = F.size(values)
    powers = F.sequence(F.lit(3), F.floor(F.log2(n + 0.5)).cast("int") - 1)

    def point(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1), lambda c: _rescaled_range(F.slice(values, c * size + 1, size)))
        mean = let(F.array_compact(chunks), lambda r: F.try_divide(_sum(r), F.size(r).cast("double")))
        return F.struct(F.ln(size.cast("double")).alias("x"), F.ln(mean).alias("y"))

    return let(F.filter(F.transform(powers, point), lambda p: p["y"].isNotNull()), _slope)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + v)


def _slope(points: Column) -> Column:
    """Slope of the least squares through at least three points."""
    n = F.size(points).cast("double")
    start = F.struct(*[F.lit(0.0).cast("double").alias(k) for k in ("x", "y", "xx", "xy")])
    add = lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["xy"] + p["x"] * p["y"]).alias("xy"))
    slope = F.aggregate(points, start, add, lambda a: F.try_divide(n * a["xy"] - a["x"] * a["y"], n * a["xx"] - a["x"] * a["x"]))
    return F.when(n >= 3, slope)


def adf_test_stat(value: ColumnOrName, ts: ColumnOrName, over: WindowSpec | None = None) -> Column:
    """t of the level before in a regression of the changes on it, with intercept and without lags.

    Null below 10 rows, for a constant series and for one without residual.
    """
    series = ordered(ts, over, v=value)
    start = {"p": None, "n": 0, "mx": 0, "my": 0, "xx": 0, "xy": 0, "yy": 0}

    def step(a: Column, x: Column) -> dict[str, Column]:
        # running means and centred sums, which do not cancel for levels far from 0
        first, u = a["p"].isNull(), a["p"]
        d = x["v"] - a["p"]
        n = a["n"] + 1
        dx, dy = u - a["mx"], d - a["my"]
        mx, my = a["mx"] + dx / n, a["my"] + dy / n
        new = {"n": n, "mx": mx, "my": my, "xx": a["xx"] + dx * (u - mx), "xy": a["xy"] + dx * (d - my), "yy": a["yy"] + dy * (d - my)}
        return {"p": x["v"], **{k: F.when(first, a[k]).otherwise(v) for k, v in new.items()}}

    def finish(a: Column) -> Column:
        beta = F.try_divide(a["xy"], a["xx"])
        rest = a["yy"] - beta * a["xy"]
        error = F.sqrt(F.when((rest > 0) & (a["xx"] > 0), rest / (a["n"] - 2) / a["xx"]))
        return beta / error

    return F.when(F.size(series) >= 10, fold(series, start, step, finish))
