"""One surviving record for each group of duplicates, and which of their values are true.

``consolidate`` takes each field from the first row that has it, in an order of trust that is
given. ``judge`` infers trust: each source has a sensitivity (it reports a true value) and a
specificity (it does not report a false one), found by expectation-maximisation together with
the chance that each value is true; a field keeps every value judged true.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bitemporal import near_periods
from tickloom.session import materialize


def consolidate(df: DataFrame, keys: Sequence[str], date: str, apart: int, row: str, fields: Sequence[str], trust: Sequence[Column]) -> DataFrame:
    """``(keys, period, first_id, rows, {field}_from)`` per group of two or more rows.

    A group are the rows of equal ``keys`` whose ``date`` lies within ``apart`` days of the next
    one's; null keys or dates belong to no group. ``{field}_from`` is the id of the first row by
    ``trust`` (ascending, nulls first), then ``row``, where the field is not null; 0 if there is
    none. Repeated rows count each.

    Rows are reduced per keys and date before they are ordered by date, so a group of any size
    comes as partial results, and one task sees no more of a key than it has dates.
    """
    best = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(trust)], F.col(row).alias("row"))
    known = df.where(F.col(date).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    dated = known.groupBy(*keys, date).agg(F.min(row).alias("first_id"), F.count("*").alias("rows"), *[F.min(F.when(F.col(f).isNotNull(), best)).alias(f"{f}_from") for f in fields])
    groups = (
        near_periods(dated, keys, date, apart, "period").groupBy(*keys, "period")
        .agg(F.min("first_id").alias("first_id"), F.sum("rows").alias("rows"), *[F.min(f"{f}_from").alias(f"{f}_from") for f in fields])
    )
    return groups.where("rows >= 2").select(*keys, "period", "first_id", "rows", *[F.coalesce(F.col(f"{f}_from")["row"], F.lit(0).cast("bigint")).alias(f"{f}_from") for f in fields])


@dataclass(frozen=True)
class Quality:
    """Start values, the prior weight that keeps rates off 0 and 1, and when to stop; up to ``local`` patterns are fitted on the driver."""

    prior: float = 0.5
    sensitivity: float = 0.7
    specificity: float = 0.8
    weight: float = 5.0
    rounds: int = 200
    tolerance: float = 1e-6
    local: int = 200_000


class _Rates:
    """Sensitivities, specificities and the prior chance of truth of one field, and their expectation-maximisation."""

    def __init__(self, sources: int, q: Quality):
        self.sources, self.q = sources, q
        self.sens, self.spec, self.prior = np.full(sources, q.sensitivity), np.full(sources, q.specificity), q.prior

    def truth(self, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        """The chance of truth of each pattern of claims."""
        bits = np.int64(1) << np.arange(self.sources, dtype=np.int64)
        y, m = ((x[:, None] & bits) > 0 for x in (yes, no))
        odds = np.log(self.prior / (1 - self.prior)) + y @ np.log(self.sens / (1 - self.spec)) + m @ np.log((1 - self.sens) / self.spec)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def expected(self, yes: np.ndarray, no: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What the next rates are made of, as sums over patterns: true and false claims and silences by source, then truth and number in all."""
        bits = np.int64(1) << np.arange(self.sources, dtype=np.int64)
        y, m = ((x[:, None] & bits) > 0 for x in (yes, no))
        truth = self.truth(yes, no)
        t, f = truth * n, (1 - truth) * n
        return np.concatenate([t @ y, t @ m, f @ y, f @ m, [t.sum(), n.sum()]])

    def improve(self, sums: np.ndarray) -> float:
        """The next rates; how far they moved."""
        q, (ty, tm, fy, fm) = self.q, sums[:-2].reshape(4, -1)
        sens = (ty + q.weight * q.sensitivity) / (ty + tm + q.weight)
        spec = (fm + q.weight * q.specificity) / (fy + fm + q.weight)
        prior = float(np.clip((sums[-2] + 1) / (sums[-1] + 2), 0.01, 0.99))
        moved = max(np.abs(sens - self.sens).max(), np.abs(spec - self.spec).max(), abs(prior - self.prior))
        self.sens, self.spec, self.prior = sens, spec, prior
        return float(moved)


def estimate(yes: np.ndarray, no: np.ndarray, n: np.ndarray, sources: int, q: Quality) -> _Rates:
    """The rates fitted to patterns of claims.

    Pattern ``i`` occurs ``n[i]`` times; bit ``s`` of ``yes[i]`` says that source ``s`` reports the
    value, of ``no[i]`` that it reports on the group but not this value.
    """
    rates = _Rates(sources, q)
    for _ in range(q.rounds):
        if rates.improve(rates.expected(yes, no, n)) < q.tolerance:
            break
    return rates


def _fitted(patterns: DataFrame, fields: Sequence[str], sources: int, q: Quality) -> dict[str, _Rates]:
    """The rates of each field, fitted where the patterns are; each round brings one row per field to the driver."""
    rates = {f: _Rates(sources, q) for f in fields}
    moving = set(fields)
    for _ in range(q.rounds):
        now = dict(rates)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros(4 * sources + 2) for f in now}  # noqa: B023
            for batch in batches:
                field = np.array(batch.column(0).to_pylist())
                yes, no, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
                for f in set(field.tolist()):
                    some = field == f
                    sums[f] += now[f].expected(yes[some], no[some], n[some].astype(float))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["field", "sums"])

        parts = patterns.select("field", "yes", "no", "n").where(F.col("field").isin(sorted(moving))).mapInArrow(expect, "field string, sums array<double>")
        total = parts.select("field", F.posexplode("sums").alias("k", "x")).groupBy("field", "k").agg(F.sum("x").alias("x")).collect()
        for f in list(moving):
            sums = np.zeros(4 * sources + 2)
            for r in total:
                if r["field"] == f:
                    sums[r["k"]] = r["x"]
            if rates[f].improve(sums) < q.tolerance:
                moving.discard(f)
        if not moving:
            break
    return rates


def judge(claims: DataFrame, group: Sequence[str], source: Column, sources: int, quality: Quality = Quality()) -> tuple[DataFrame, DataFrame]:
    """From claims ``(group, field, value)``: what is true, and how good each source is per field.

    ``source`` numbers a claim's source from 0 to ``sources`` - 1 (at most 62). Gives
    ``(group, field, value, claims, truth)`` with the chance that the value is true, and
    ``(field, source, sensitivity, specificity)``. Null values claim nothing; several rows of a
    source that claim one value are one claim, counted in ``claims``.

    A value matters only by which sources claim it and which report another, so the model is
    fitted to counts of these patterns: on the driver up to ``quality.local`` of them, more where they
    are, with equal results. Claims are combined by value before they meet the others of their group.
    """
    if not 0 < sources <= 62:
        raise ValueError("between 1 and 62 sources")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), source.cast("int"))
    values = claims.where(F.col("value").isNotNull()).withColumn("_bit", bit).groupBy(*group, "field", "value").agg(F.bit_or("_bit").alias("yes"), F.count("*").alias("claims"))
    values = materialize(values)
    everyone = values.groupBy(*group, "field").agg(F.bit_or("yes").alias("every"))
    named = values.join(everyone, [*group, "field"]).withColumn("no", F.col("every").bitwiseAND(F.bitwise_not("yes"))).drop("every")
    patterns = materialize(named.groupBy("field", "yes", "no").agg(F.count("*").alias("n")))
    fields = [r[0] for r in patterns.select("field").distinct().orderBy("field").collect()]
    if patterns.count() <= quality.local:
        rates = {f: estimate(*(part[c].to_numpy(np.int64) for c in ("yes", "no", "n")), sources, quality) for f, part in patterns.toPandas().groupby("field")}
    else:
        rates = _fitted(patterns, fields, sources, quality)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = np.array(batch.column(0).to_pylist())
            yes, no = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            truth = np.zeros(len(field))
            for f in set(field.tolist()):
                truth[field == f] = rates[f].truth(yes[field == f], no[field == f])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(truth)], names=["field", "yes", "no", "truth"])

    known = patterns.select("field", "yes", "no").mapInArrow(weigh, "field string, yes bigint, no bigint, truth double")
    judged = named.join(known, ["field", "yes", "no"]).select(*group, "field", "value", "claims", "truth")
    table = [(f, k, float(r.sens[k]), float(r.spec[k])) for f, r in rates.items() for k in range(sources)]
    return judged, claims.sparkSession.createDataFrame(table, "field string, source int, sensitivity double, specificity double")
