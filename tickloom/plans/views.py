"""Market data derived from the test tables, for Spark and, with the same rows, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.returns import first_s, last_s
from tickloom.functions.scalars import pct_change, timebucket
from tickloom.session import table

HOUR = 3_600_000_000


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of six hours; counts stand for volumes."""
    by = ticks(spark, sf).groupBy("symbol", timebucket("ts", 6 * HOUR).alias("bar"))
    return by.agg(first_s("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last_s("price", "ts").alias("close"), F.count("*").cast("double").alias("volume")).withColumnRenamed("bar", "ts")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the return since the bar before, and that of the highs as a benchmark."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars(spark, sf).withColumns({"ret": pct_change("close", F.lag("close").over(w)), "bench": pct_change("high", F.lag("high").over(w))})


def candles(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the opens and closes of the two before them."""
    w = Window.partitionBy("symbol").orderBy("ts")
    lags = {f"{c}{n}": F.lag(c, n).over(w) for c in ("open", "close") for n in (1, 2)}
    return bars(spark, sf).withColumns(lags).withColumn("bar_us", F.unix_micros("ts"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Price per unit and quantity of all lines by day of shipment."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("timestamp").alias("ts"))
    return lines.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))


def options(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of options made from parts."""
    size = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("s"), (F.col("p_retailprice") * (0.8 + size / 125)).alias("k"), (size / 25).alias("t"), F.lit(0.03).alias("r"), (0.1 + size / 200).alias("v"))


def bonds(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of bonds made from parts."""
    return table(spark, sf, "part").select("p_partkey", F.lit(1000.0).alias("f"), (F.col("p_size").cast("double") / 500).alias("c"), (0.01 + (F.col("p_partkey") % 50).cast("double") / 1000).alias("y"), F.col("p_size").cast("int").alias("n"), F.lit(2.0).alias("q"))


BARS = """bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL),
b AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n, lag(open) OVER w AS open1, lag(close) OVER w AS close1, lag(high) OVER w AS high1, lag(low) OVER w AS low1,
 lag(open, 2) OVER w AS open2, lag(close, 2) OVER w AS close2, close / nullif(lag(close) OVER w, 0) - 1 AS ret, high / nullif(lag(high) OVER w, 0) - 1 AS bench, epoch_us(ts) AS bar_us
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
DAILY = "daily AS (SELECT l_shipdate AS ts, sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL)"
OPTIONS = "o AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8 + CAST(p_size AS DOUBLE) / 125) AS k, CAST(p_size AS DOUBLE) / 25 AS t, CAST(0.03 AS DOUBLE) AS r, 0.1 + CAST(p_size AS DOUBLE) / 200 AS v FROM part)"
BONDS = "g AS (SELECT p_partkey, CAST(1000 AS DOUBLE) AS f, CAST(p_size AS DOUBLE) / 500 AS c, 0.01 + CAST(p_partkey % 50 AS DOUBLE) / 1000 AS y, p_size AS n, CAST(2 AS DOUBLE) AS q FROM part)"
