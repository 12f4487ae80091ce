"""Queries of the data sources over recorded answers, and of the streams over the events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import closed
from tickloom.plans import answers
from tickloom.plans.views import ticks
from tickloom.registry import read, register
from tickloom.session import shared_folder, table
from tickloom.sources.samples import SAMPLES
from tickloom.streaming.bars import stream_ema as ema_of
from tickloom.streaming.bars import stream_ohlc as bars_of


def _source(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        register(spark)
        options, recorded = SAMPLES[name]
        rows = read(spark, name, **options, responses=json.dumps(recorded))
        return rows.select(*[_plain(c, kind) for c, kind in rows.dtypes])

    return query


def _plain(name: str, kind: str) -> Column:
    """Times as microseconds, dates and lists as text."""
    if kind == "timestamp":
        return F.unix_micros(name).alias(f"{name}_us")
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name) if kind.startswith("array") else F.col(name).cast("string" if kind == "date" else kind).alias(name)


#: Micro-batches the events come in, and the files of each.
BATCHES, FILES = 4, 2


def _drained(spark: SparkSession, sf: str, made: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream over all events wrote by its end, with the number of the micro-batch as ``batch``.

    The events are laid out in files by time first, so that the stream has several micro-batches to carry state over.
    """
    path = shared_folder(spark)
    events = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.floor((F.unix_micros("ts") - first) * BATCHES / max(1, last - first)), F.lit(BATCHES - 1))
    for k in range(BATCHES):  # the stream takes files in the order in which they were written
        events.where(part == k).repartition(FILES).write.mode("append").parquet(f"{path}/in")
    stream = made(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in"))
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out")


def stream_ohlc(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of the events as a stream, each written once the watermark has passed it; those still open are left out."""
    bars = _drained(spark, sf, lambda s: bars_of(s, "1 day", ["symbol"]), "append")
    return bars.select("symbol", F.unix_micros("ts").alias("ts_us"), "open", "high", "low", "close", "n")


def stream_ema(spark: SparkSession, sf: str) -> DataFrame:
    """EMA(20) of the events as a stream, after the last micro-batch with rows of the symbol."""
    every = _drained(spark, sf, lambda s: ema_of(s, "symbol", 20), "update")
    last = every.groupBy("symbol").agg(F.max_by(F.struct("ema", "n"), "batch").alias("x"))
    return last.select("symbol", F.round("x.ema", 6).alias("ema"), "x.n")


def tick_ema(spark: SparkSession, sf: str) -> DataFrame:
    """EMA(20) of the values of each event type, and their number."""
    return closed.prepare(ticks(spark, sf), ["symbol"], "ts", ["price"]).groupBy("symbol").agg(F.round(closed.ema("price", 20), 6).alias("ema"), F.count("*").alias("n"))


QUERIES = {f"source_{name}": _source(name) for name in SAMPLES} | {"stream_ohlc": stream_ohlc, "stream_ema": stream_ema, "tick_ema": tick_ema}
_EMA = "SELECT event_type AS symbol, round(list_reduce(list(value ORDER BY ts), lambda a, x: x * (2.0::DOUBLE / 21) + a * (1 - 2.0::DOUBLE / 21)), 6) AS ema, count(*) AS n FROM events GROUP BY 1"
ORACLE = answers.ORACLE | {
    "stream_ohlc": "SELECT event_type AS symbol, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS ts_us, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY event_type, time_bucket(INTERVAL 1 DAY, ts) HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "stream_ema": _EMA,
    "tick_ema": _EMA,
}
