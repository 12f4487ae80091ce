"""Documents into containers of a fixed number of tokens, by way of windows of several context sizes.

A document is routed to the smallest context size of which it fills at most half, long ones to the
whole container. Each tier is packed into windows of its size, from the longest tier down: a window
is opened with the longest document of its tier, and its gap is filled with the longest that fit,
of the same tier or a shorter one. Windows of a size make up whole containers, and containers are
dealt out to steps by size and filling, so that steps carry like loads.

Lengths are whole numbers up to the capacity, so a histogram with one entry per length describes
all documents. It is packed on the driver, each kind of filling being repeated as often as the counts
allow; the plan is as long as the capacity lets it be, however many documents there are. Documents
find their places by their rank among those of equal length.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts a text before merging.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc, n_tokens)`` of whole texts; a null or empty text has none.

    The file of the vocabulary need only be where the driver is; workers get it from there.
    """
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc", "n_tokens"])

    return df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc bigint, n_tokens bigint")


@dataclass(frozen=True)
class Plan:
    """Places by length and rank: entry ``i`` holds ranks from ``first[i]`` of items of ``length[i]``,
    ``times[i]`` to a window of ``size[i]`` tokens from ``offset[i]`` on, the windows beginning with
    ``window[i]`` of the containers from ``container[i]`` on, each of which has ``per[i]``."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    size: np.ndarray
    offset: np.ndarray
    window: np.ndarray
    container: np.ndarray
    per: np.ndarray
    containers: int


def tier_of(length: int, sizes: Sequence[int]) -> int:
    """The smallest of the ascending ``sizes`` of which a document fills at most half, else the largest."""
    return next((t for t in sizes if 2 * length <= t), sizes[-1])


def _windows(left: dict[int, int], sizes: Sequence[int]) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """Kinds of windows as ``(size, (length, times) of its items, how often)`` until nothing is left."""
    lengths = sorted(left)
    for size in reversed(sizes):
        while lengths and (size == sizes[0] or tier_of(lengths[-1], sizes) >= size):
            gap, filling = size, []
            at = len(lengths) - 1
            while at >= 0:
                k = lengths[at]
                times = min(left[k], gap // k)
                if times:
                    filling.append((k, times))
                    gap -= k * times
                at = min(at - 1, bisect_right(lengths, gap) - 1)
            again = min(left[k] // times for k, times in filling)
            for k, times in filling:
                left[k] -= times * again
                if not left[k]:
                    lengths.pop(bisect_right(lengths, k) - 1)
            yield size, filling, again


def plan(counts: dict[int, int], capacity: int, tiers: tuple[int, ...]) -> Plan:
    """A packing of ``counts[length]`` items of each length from 1 to ``capacity``; ``tiers`` must divide the capacity."""
    if any(t < 1 or capacity % t for t in tiers):
        raise ValueError(f"context sizes {tiers} must divide the capacity {capacity}")
    sizes = sorted({*tiers, capacity})
    kinds = list(_windows({k: n for k, n in counts.items() if n > 0}, sizes))
    kinds.sort(key=lambda kind: (-kind[0], -sum(k * times for k, times in kind[1])))  # fullest first, for like steps
    taken = dict.fromkeys(counts, 0)
    entries: list[tuple[int, ...]] = []
    container = window = size_before = 0
    for size, filling, again in kinds:
        if size != size_before:
            container += -(-window * size_before // capacity)
            window, size_before = 0, size
        offset = 0
        for k, times in filling:
            entries.append((k, taken[k], times, size, offset, window, container, capacity // size))
            offset += k * times
            taken[k] += times * again
        window += again
    entries.sort()
    columns = np.array(entries, np.int64).reshape(-1, 8).T
    return Plan(*columns, containers=container - (-window * size_before // capacity))


def pack(counts: DataFrame, capacity: int, tiers: tuple[int, ...], group: int, buckets: int = 1024) -> DataFrame:
    """Assign documents ``(doc, n_tokens)`` to containers: ``(doc, piece, n_tokens, window, container, offset, step)``.

    A document of up to ``capacity`` tokens is one piece in one container; a longer one fills
    containers of its own with pieces of ``capacity``, the rest being an item like others. A
    document without tokens needs no container and has nulls there. ``offset`` is the token of the
    container at which the piece begins, ``window`` the context size of its part of the container;
    ``tiers`` are the context sizes below the capacity, which they must divide. Containers are dealt out to steps of ``group``, back and
    forth in order of their filling, so that steps carry like loads. Repeated ids are packed each;
    null counts as no tokens.

    Of the documents only the histogram of lengths, at most ``capacity`` counts, reaches the
    driver. Ranks among equal lengths are counted in ``buckets`` by hash, so that one length that
    most documents share does not meet in one task; the counts meet the documents where these are
    ordered by length and bucket anyway, and are broadcast nowhere.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0).cast("bigint"))
    documents = counts.select("doc", n.alias("all"))
    whole = F.floor((F.col("all") - 1) / capacity)
    pieces = documents.withColumn("piece", F.explode(F.when(F.col("all") > capacity, F.sequence(F.lit(0).cast("bigint"), whole)).otherwise(F.array(F.lit(0).cast("bigint")))))
    length = F.when(F.col("all") == 0, 0).otherwise(F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity)).cast("bigint")
    items = pieces.select("doc", "piece", length.alias("length")).withColumn("bucket", F.pmod(F.xxhash64("doc", "piece"), F.lit(buckets)).cast("int"))
    cells = items.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))))
    histogram = {row[0]: row[1] for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    p = plan(histogram, capacity, tiers)
    steps = max(1, -(-p.containers // group))
    shift = 1 << 42
    keys = p.length * shift + p.first

    ranked = (
        items.join(cells.select("length", "bucket", "before").hint("merge"), ["length", "bucket"], "left")
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc", "piece")) - 1)
        .select("doc", "piece", "length", "rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            some = size > 0
            rank = batch.column("rank").fill_null(0).to_numpy()
            if len(keys):
                at = np.maximum(np.searchsorted(keys, size * shift + rank, side="right") - 1, 0)
                inside = rank - p.first[at]
                window, width = p.window[at] + inside // p.times[at], p.size[at]
                container = p.container[at] + window // p.per[at]
                offset = window % p.per[at] * width + p.offset[at] + inside % p.times[at] * size
            else:
                container = offset = width = np.zeros(len(size), np.int64)
            turn, seat = container // steps, container % steps
            step = np.where(turn % 2 == 0, seat, steps - 1 - seat)
            out = [pa.array(x, pa.int64(), mask=~some) for x in (width, container, offset, step)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("piece"), batch.column("length"), *out], names=["doc", "piece", "n_tokens", "window", "container", "offset", "step"])

    return ranked.mapInArrow(place, "doc bigint, piece bigint, n_tokens bigint, window bigint, container bigint, offset bigint, step bigint")
