"""Cut the series of hot keys into blocks that carry a margin of their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

#: Slots of a place share a coarser slot of this many, so that rows find their place by an equal value.
SPAN = 24


def hot_keys(df: DataFrame, key: str, size: int) -> DataFrame:
    """The keys with more than ``size`` rows, ``(_key)``; of ``df`` only the keys are read. Written, so that their size is known where they are joined."""
    return materialize(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_all")).where(F.col("_all") > size).select("_key"))


def hot_places(df: DataFrame, key: str, slot: Column, size: int, margin: int) -> DataFrame:
    """Where the slots of the keys of ``df`` go: ``(_key, _span, _from, _to, _home, _blocks)``.

    A key is cut along ``slot``, a whole number that grows with time, such as an hour: a new block
    begins with the first slot after each ``size`` rows; whole slots with at least ``margin`` rows on
    either side (all there are, if fewer) go to the neighbour too. Rows are counted by slot before
    they are ordered, so a hot key gathers only its slots, whose number the calendar bounds. Slots
    that go to the same blocks make one row per ``SPAN`` slots, from ``_from`` to ``_to``. ``margin``
    must not exceed ``size``; neither key nor slot may be null.
    """
    counts = df.groupBy(F.col(key).alias("_key"), slot.cast("bigint").alias("_slot")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0))
    hot = counts.withColumn("_upto", upto).withColumns({"_first": F.col("_upto") - F.col("_n"), "_home": F.floor((F.col("_upto") - F.col("_n")) / size)})
    inside = Window.partitionBy("_key", "_home")
    hot = hot.withColumns({"_begin": F.min("_first").over(inside), "_end": F.max("_upto").over(inside)})
    # blocks are numbered without holes, so that the neighbour is one away
    hot = hot.withColumn("_home", F.dense_rank().over(Window.partitionBy("_key").orderBy("_home")) - 1)
    near = F.array(
        F.when((F.col("_first") < F.col("_begin") + margin) & (F.col("_home") > 0), F.col("_home") - 1),
        F.when(F.col("_upto") > F.col("_end") - margin, F.col("_home") + 1),
    )
    placed = hot.withColumn("_blocks", F.array_compact(F.concat(F.array("_home"), near))).withColumn("_span", F.floor(F.col("_slot") / SPAN))
    return materialize(placed.groupBy("_key", "_span", "_home", "_blocks").agg(F.min("_slot").alias("_from"), F.max("_slot").alias("_to")))


def in_blocks(df: DataFrame, places: DataFrame, key: str, slot: Column) -> DataFrame:
    """Each row with its ``block``, and a copy (``own`` false) for each block whose margin it is in."""
    named = df.withColumn("_slot", slot.cast("bigint"))
    on = (F.col(key) == F.col("_key")) & (F.floor(F.col("_slot") / SPAN) == F.col("_span")) & F.col("_slot").between(F.col("_from"), F.col("_to"))
    placed = named.join(places, on).select(*df.columns, "_home", F.explode("_blocks").alias("block"))
    return placed.select(*df.columns, "block", (F.col("block") == F.col("_home")).alias("own"))


def joined_runs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of an equal value that reach over the edges of blocks: ``edges`` with ``run``, ``before`` and ``total``.

    ``edges`` has for each of ``keys`` and ``block`` the ``value`` and length ``n`` of the run at its
    beginning (``side`` 0) and, if that is not the whole block, of that at its end (``side`` 1).
    ``run`` numbers runs within the keys, ``before`` is the part of a run in earlier blocks, ``total``
    its length in all. A key gathers two small rows per block.
    """
    order = Window.partitionBy(*keys).orderBy("block", "side")
    new = F.when((F.col("side") == 0) & (F.lag("value").over(order) == F.col("value")), 0).otherwise(1)
    runs = edges.withColumn("_new", new).withColumn("run", F.sum("_new").over(order)).drop("_new")
    same = Window.partitionBy(*keys, "run")
    earlier = same.orderBy("block", "side").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("bigint")), "total": F.sum("n").over(same)})


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key and block, the first two columns, of a partition sorted by them; held is one block at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])) + 1).tolist(), batch.num_rows]
        if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (batch.column(0)[0].as_py(), batch.column(1)[0].as_py()):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def together(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows of small batches in batches of about ``rows``, each of which costs the receiver the same."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
