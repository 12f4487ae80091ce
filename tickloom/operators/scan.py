"""Running values along a series that need no single task for the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """Add running values up to each row, or up to the one ``before``.

    ``last`` gives the last non-null value, ``total`` the sum, ``greatest`` the maximum. Rows are
    ordered by ``order`` (nulls first; equal rows in any order), of which ``slot`` must be a
    coarser, non-decreasing function, such as the day of a time. Values run within each key and
    slot; what comes from earlier slots is carried over from one row per slot, so that a key
    gathers no more rows than the calendar has slots. Null keys are one key; with no ``keys`` all
    rows are one series.
    """
    last, total, greatest = last or {}, total or {}, greatest or {}
    every = {**last, **total, **greatest}
    named = df.withColumn("_slot", slot).withColumns({f"_{n}": c for n, c in every.items()})
    within = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = named.withColumns({f"_{n}_here": _running(n, last, total).over(within) for n in every})
    rank = F.struct(*order)
    summary = named.groupBy(*keys, "_slot").agg(
        *[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), rank)).alias(f"_{n}_all") for n in last],
        *[F.sum(f"_{n}").alias(f"_{n}_all") for n in total],
        *[F.max(f"_{n}").alias(f"_{n}_all") for n in greatest],
    )
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slot").alias("_at"),
        *[(F.last(f"_{n}_all", ignorenulls=True) if n in last else F.sum(f"_{n}_all") if n in total else F.max(f"_{n}_all")).over(earlier).alias(f"_{n}_then") for n in every],
    )
    on = F.col("_slot").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        on &= local[k].eqNullSafe(carried[f"_k{i}"])
    met = local.join(carried, on, "left")
    values = {}
    for n in every:
        here, then = F.col(f"_{n}_here"), F.col(f"_{n}_then")
        values[n] = F.coalesce(here, then) if n in last else F.coalesce(here + then, here, then) if n in total else F.greatest(here, then)
    return met.select(*[local[c] for c in df.columns if c not in values], *[v.alias(n) for n, v in values.items()])


def _running(name: str, last: dict, total: dict) -> Column:
    return F.last(f"_{name}", ignorenulls=True) if name in last else F.sum(f"_{name}") if name in total else F.max(f"_{name}")


def day(ts: str) -> Column:
    return F.to_date(F.col(ts))
