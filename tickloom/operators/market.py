"""Bars, returns and as-of joins."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.returns import first_s, last_s
from tickloom.functions.scalars import log_return, pct_change
from tickloom.operators.scan import day, scan

_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: Buckets are counted from Monday, 2000-01-03, those of months from 2000-01-01.
_ORIGIN = 10_959 * _MICROS["day"]


def bucket_start(ts: Column, width: str) -> Column:
    """Start of the bucket of ``ts``; ``width`` is a number and a unit, such as ``15 minutes`` or ``1 month``."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", width.lower())
    if not found or int(found[1]) < 1 or found[2] not in _MICROS | _MONTHS:
        raise ValueError(f"no such width: {width!r}")
    n, unit = int(found[1]), found[2]
    t = ts.cast("timestamp")
    if unit in _MICROS:
        w = n * _MICROS[unit]
        from_origin = F.unix_micros(t) - F.lit(_ORIGIN)
        return F.timestamp_micros(F.unix_micros(t) - F.pmod(from_origin, F.lit(w)))
    w = n * _MONTHS[unit]
    months = (F.year(t) - 2000) * 12 + F.month(t) - 1
    return F.add_months(F.lit("2000-01-01").cast("date"), (months - F.pmod(months, F.lit(w))).cast("int")).cast("timestamp")


def resample_ohlc(df: DataFrame, width: str, keys: Sequence[str] = (), ts: str = "ts", columns: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Bars of a greater width: ``(keys, ts, open, high, low, close, volume)``.

    Open and close are those at the least and greatest time with one, the rest skips nulls; rows
    with a null ``ts`` form a bucket of their own. One aggregation that combines before the shuffle.
    """
    o, h, l, c, v = columns  # noqa: E741
    by = df.groupBy(*keys, bucket_start(F.col(ts), width).alias("_bucket"))
    bars = by.agg(first_s(o, ts).alias("open"), F.max(h).alias("high"), F.min(l).alias("low"), last_s(c, ts).alias("close"), F.sum(v).alias("volume"))
    return bars.select(*keys, F.col("_bucket").alias("ts"), "open", "high", "low", "close", "volume")


def with_returns(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", price: str = "price", ties: Sequence[str] = ()) -> DataFrame:
    """``(keys, ts, price, simple_return, log_return)`` against the row before in order of ``ts``, ``ties``, ``price``.

    The returns are null for the first row, next to a null price and after a price of 0.
    """
    order = [ts, *ties, price]
    rows = scan(df.select(*keys, *dict.fromkeys(order)), keys, order, day(ts), last={"_p": F.struct(F.col(price).alias("x"))}, before=True)
    p = F.col("_p")["x"]
    return rows.select(*keys, F.col(ts).alias("ts"), F.col(price).alias("price"), pct_change(F.col(price), p).alias("simple_return"), F.when(p != 0, log_return(F.col(price), p)).alias("log_return"))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), suffix: str = "_r") -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` whose ``on`` is not later.

    Columns of ``right`` other than ``by`` get ``suffix`` where ``left`` has the name, its ``on``
    always. Without such a row they are null. Of rows of equal ``on`` the greatest by its other
    columns counts; nulls in ``on`` or ``by`` match nothing. Both sides are merged and scanned by
    day, so that a key with many rows is no single task.
    """
    names = {c: f"{c}{suffix}" if c in left.columns or c == on else c for c in right.columns if c not in by}
    held = F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    kind = dict(left.dtypes)[on]
    rest = [c for c in left.columns if c not in (*by, on)]
    known = right.where(F.col(on).isNotNull()).select(*by, F.col(on).cast(kind).alias("_t"), F.lit(0).alias("_side"), held.alias("_right"))
    for c in by:
        known = known.where(F.col(c).isNotNull())
    known = known.groupBy(*by, "_t", "_side").agg(F.max("_right").alias("_right"))
    rows = left.select(*by, F.col(on).alias("_t"), F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_row"), *rest).alias("_left"))
    both = rows.unionByName(known, allowMissingColumns=True)
    merged = scan(both, by, ["_t", "_side"], F.to_date("_t") if kind.startswith(("timestamp", "date")) else F.floor(F.col("_t") / 100_000), last={"_found": F.col("_right")})
    found = F.when(F.col("_t").isNotNull(), F.col("_found"))
    return merged.where("_side = 1").select(*[F.col("_t").alias(on) if c == on else F.col(c) if c in by else F.col("_left")[c].alias(c) for c in left.columns], *[found[n].alias(n) for n in names.values()])
