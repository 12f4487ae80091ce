"""Irregular readings on a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def period_number(date: Column, freq: Column) -> Column:
    """A count of periods that grows by one from each to the next; freq is D (weekdays), W, M or Q.

    A Saturday or Sunday is no weekday and gives null, as does another freq.
    """
    days = F.datediff(date, F.lit(EPOCH).cast("date"))
    week = F.floor((days + 3) / 7)  # 1970-01-01 was a Thursday
    months = F.year(date) * 12 + F.month(date) - 1
    return (
        F.when((freq == "D") & (days + 3 - week * 7 < 5), week * 5 + days + 3 - week * 7)
        .when(freq == "W", week)
        .when(freq == "M", months)
        .when(freq == "Q", F.floor(months / 3))
        .cast("bigint")
    )


def period_start(number: Column, freq: Column) -> Column:
    """The first day of a period."""
    week = F.floor(number / 5)
    days = F.when(freq == "D", week * 7 - 3 + number - week * 5).when(freq == "W", number * 7 - 3)
    months = F.when(freq == "Q", number * 3).otherwise(number)
    return F.when(freq.isin("D", "W"), F.date_add(F.lit(EPOCH).cast("date"), days.cast("int"))).otherwise(
        F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    )


def regularize(df: DataFrame, key: str, date: str, value: str, freq: Column, order: list[str], gap: int) -> DataFrame:
    """One row per key and period from its first to its last non-null value.

    Gives ``(key, freq, period, value, missing, run, filled)``: ``period`` is the first day of the
    period, ``value`` its last reading by ``date`` and ``order``, ``missing`` whether it has none,
    ``run`` the number of missing periods in its gap (0 if present), ``filled`` the value or, in
    gaps of up to ``gap`` periods, the linear interpolation in time between the readings on
    either side; in longer gaps it is null. Rows with a null key, date, value or unknown freq and
    weekend rows of freq D are left out; of repeated and equal rows one counts; a key without values gives no row.

    Readings are reduced to one per key and period before the merge, so that a key has no more
    rows than the calendar has periods, however many readings it has. In order of time each reading
    then meets the next one, and is followed by the grid points up to it, which so have the reading
    before them and the one after them. The table is read once and ordered once.
    """
    named = df.select(F.col(key).alias("_key"), F.col(date).cast("date").alias("_date"), F.col(value).cast("double").alias("_value"), freq.alias("_freq"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    number = period_number(F.col("_date"), F.col("_freq"))
    last = F.max(F.struct("_date", *[f"_o{i}" for i in range(len(order))], "_value")).alias("_last")
    readings = (
        named.where(F.col("_key").isNotNull() & F.col("_date").isNotNull() & F.col("_value").isNotNull())
        .withColumn("_number", number).where(F.col("_number").isNotNull())
        .groupBy("_key", "_freq", "_number").agg(last)
        .select("_key", "_freq", "_number", F.struct(F.col("_last._date").alias("date"), F.col("_last._value").alias("value")).alias("_before"))
    )
    along = Window.partitionBy("_key", "_freq").orderBy("_number")
    met = readings.withColumns({"_after": F.lead("_before").over(along), "_gap": F.coalesce(F.lead("_number").over(along) - F.col("_number") - 1, F.lit(0))})
    sides = met.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_gap"))))
    missing = F.col("_step") > 0
    start = period_start(F.col("_number") + F.col("_step"), F.col("_freq"))
    run = F.when(missing, F.col("_gap")).otherwise(0)
    span = F.datediff(F.col("_after.date"), F.col("_before.date"))
    share = F.try_divide(F.datediff(F.col("period"), F.col("_before.date")).cast("double"), span.cast("double"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    between = F.col("_before.value") + (F.col("_after.value") - F.col("_before.value")) * share
    return (
        sides.withColumn("period", start).withColumn("run", run.cast("bigint"))
        .select(
            F.col("_key").alias(key), F.col("_freq").alias("freq"), "period", F.when(~missing, F.col("_before.value")).alias("value"), missing.alias("missing"), "run",
            F.when(~missing, F.col("_before.value")).when(F.col("run") <= gap, between).alias("filled"),
        )
    )
