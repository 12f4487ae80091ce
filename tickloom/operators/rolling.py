"""Totals over trailing periods for every day, by sums inside blocks of the period's length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import sorted_groups, together
from tickloom.session import materialize


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the ``values`` of its last row by ``order`` (nulls first)."""
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in values])


def _trailing(values: np.ndarray, start: int, period: int) -> np.ndarray:
    """Totals over the ``period`` days up to each, days before ``start`` counting as 0.

    Days are cut into blocks of the period's length; a total is the prefix of its block and the
    suffix of the block before from the day after the window's start on.
    """
    front = start % period
    back = -(front + len(values)) % period
    blocks = np.concatenate([np.zeros(period + front, values.dtype), values, np.zeros(back, values.dtype)]).reshape(-1, period)
    prefix = np.cumsum(blocks, axis=1)
    suffix = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1]
    total = prefix[1:].copy()
    total[:, :-1] += suffix[:-1, 1:]
    return total.ravel()[front : front + len(values)]


def trailing_totals(daily: DataFrame, key: str, day: str, measures: Sequence[str], periods: Sequence[int], tail: int) -> DataFrame:
    """For each key and day a row with ``{measure}_{period}``, the total over the trailing period.

    ``daily`` has at most one row per key and day (date). Days run from a key's first to ``tail``
    days after its last, whether they have a row or not; a null measure counts as 0, null keys and
    days are left out; other columns are ignored. Totals of whole numbers are whole.

    Days are put together in spans of ten times the longest period, each with the days before it
    that its first windows reach back to; within a span every period has its own blocks. A task
    holds one span of one key, so a hot key spreads over its spans, and all periods come from one
    shuffle of daily rows.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    whole = {"tinyint", "smallint", "int", "bigint"}
    kinds = ["bigint" if dict(daily.dtypes)[m] in whole else "double" for m in measures]
    rows = daily.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(key).alias("_key"), number.alias("_day"), *[F.coalesce(F.col(m).cast(k), F.lit(0).cast(k)).alias(f"_m{i}") for i, (m, k) in enumerate(zip(measures, kinds))])
    rows = materialize(rows)  # read again for the first and last days
    names = [f"_m{i}" for i in range(len(measures))]
    reach = max(periods) - 1
    size = 10 * (reach + 1)
    span = F.floor(F.col("_day") / size).cast("int")
    ends = rows.groupBy("_key").agg(F.min("_day").alias("_from"), (F.max("_day") + tail).alias("_to"))
    none = F.lit(None)
    frame = ends.select("_key", F.explode(F.sequence(F.floor(F.col("_from") / size).cast("int"), F.floor(F.col("_to") / size).cast("int"))).alias("_span"), none.cast("int").alias("_day"), *[none.cast(k).alias(n) for n, k in zip(names, kinds)], "_from", "_to")
    late = F.col("_day") >= (span + 1) * size - reach
    held = rows.select("_key", F.explode(F.when(late, F.array(span, span + 1)).otherwise(F.array(span))).alias("_span"), "_day", *names, none.cast("int").alias("_from"), none.cast("int").alias("_to"))
    kind = dict(rows.dtypes)["_key"]
    labels = [f"{m}_{w}" for w in periods for m in measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            edge = group.column("_from").to_numpy()
            first = np.flatnonzero(~np.isnan(edge.astype(float)))
            if not len(first):  # only days that a later span reaches back to
                continue
            since, until = int(edge[first[0]]), int(group.column("_to")[int(first[0])].as_py())
            start = int(group.column("_span")[0].as_py()) * size
            at = group.column("_day").to_numpy().astype(float)
            here = np.flatnonzero(~np.isnan(at))
            place = at[here].astype(int) - (start - reach)
            a, b = max(since, start), min(until, start + size - 1)
            if a > b:
                continue
            out = []
            dense = []
            for n in names:
                x = np.zeros(reach + size, np.int64 if pa.types.is_integer(group.schema.field(n).type) else float)
                x[place] = group.column(n).take(pa.array(here)).to_numpy()
                dense.append(x)
            for w in periods:
                out += [_trailing(x, start - reach, w)[a - start + reach : b - start + reach + 1] for x in dense]
            keys = pa.array([group.column("_key")[0].as_py()] * (b - a + 1), group.schema.field("_key").type)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(a, b + 1), pa.int32()), *map(pa.array, out)], names=["_key", "_day", *[f"_t{i}" for i in range(len(out))]])

    both = held.unionByName(frame).repartition("_key", "_span").sortWithinPartitions("_key", "_span")
    totals = both.mapInArrow(lambda batches: together(run(batches)), ", ".join([f"_key {kind}", "_day int", *[f"_t{i} {kinds[i % len(kinds)]}" for i in range(len(labels))]]))
    return totals.select(F.col("_key").alias(key), F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias(day), *[F.col(f"_t{i}").alias(n) for i, n in enumerate(labels)])
