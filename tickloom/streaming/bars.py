"""Bars and exponential averages of streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.returns import first_s, last_s


def stream_ohlc(df: DataFrame, width: str, keys: Sequence[str] = (), ts: str = "ts", price: str = "price", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of prices: ``(keys, ts, open, high, low, close, n)``, with rows up to ``late`` late.

    ``width`` is a number of units of up to a week, such as ``6 hours``; buckets are those of
    ``resample_ohlc``. State per bucket is five numbers, and goes when the watermark has passed it.
    """
    marked = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    # windows of Spark begin at the epoch; these begin on Mondays as the batch operator's do
    start = "4 days" if "week" in width else "0 seconds"
    by = marked.groupBy(*keys, F.window(ts, width, startTime=start))
    bars = by.agg(first_s(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last_s(price, ts).alias("close"), F.count(price).alias("n"))
    return bars.select(*keys, F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")


def stream_ema(df: DataFrame, key: str, period: int, ts: str = "ts", price: str = "price") -> DataFrame:
    """The exponential average of each key after each micro-batch: ``(key, ts, ema, n)``.

    Rows of a micro-batch are taken in order of time; later micro-batches go on from there, so rows
    must not come later than others already seen. Nulls are skipped. State is two numbers per key.
    """
    k = 2.0 / (max(period, 1) + 1)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).dropna().sort_values(["ts", "price"], kind="stable")
        if not len(rows):
            return
        prices = rows["price"].to_numpy(float)
        value, n = state.get if state.exists else (prices[0], 0)
        # the recurrence over a batch is one sum: what was before, and each price by its distance from the end
        value = float(value * (1 - k) ** len(prices) + k * prices @ (1 - k) ** np.arange(len(prices) - 1, -1, -1))
        state.update((value, n + len(prices)))
        yield pd.DataFrame({"key": [name[0]], "ts": [rows["ts"].iloc[-1]], "ema": [value], "n": [n + len(prices)]})

    named = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(price).cast("double").alias("price"))
    out = named.groupBy("key").applyInPandasWithState(update, "key string, ts timestamp, ema double, n long", "ema double, n long", "update", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)
