"""Attributes as known at event time, by rectangles in valid and recorded time.

Versions of a key's values are cut into disjoint rectangles: over each, one version is the value
of the latest period that had begun (valid time) as far as was known (recorded time). An event is
a point in that plane. Rectangles and points meet in the cells of a grid with several widths, so
that a rectangle lies in at most two cells along an axis and a point in one cell per width.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days are counted from 1970-01-01; open ends are the day after 9999-12-31.
EPOCH = "1970-01-01"
OPEN = 2_932_897
#: Cell widths in days; each is eight times the one before, the last exceeds any span of dates.
WIDTHS = tuple(32 * 8**k for k in range(7))


def day_number(date: Column) -> Column:
    return F.datediff(date.cast("date"), F.lit(EPOCH).cast("date"))


def near_periods(df: DataFrame, keys: Sequence[str], date: str, apart: int, name: str) -> DataFrame:
    """Add ``name``, the first date of the row's period: dates up to ``apart`` days apart are one.

    ``df`` should hold few rows per key and date, as one task orders a key's rows; aggregate
    before. Periods are chains: each date lies within ``apart`` days of the one before it. Rows
    with a null date get null.
    """
    along = Window.partitionBy(*keys).orderBy(date)
    begins = F.lag(date).over(along).isNull() | (F.datediff(F.col(date), F.lag(date).over(along)) > apart)
    marked = df.withColumn("_begin", F.when(F.col(date).isNotNull() & begins, F.col(date)))
    return marked.withColumn(name, F.when(F.col(date).isNotNull(), F.last("_begin", ignorenulls=True).over(along))).drop("_begin")


def rectangles(versions: DataFrame, keys: Sequence[str], period: str, recorded: str, value: str) -> DataFrame:
    """Disjoint current-version regions ``(keys, value, v0, v1, r0, r1)`` in days, ends exclusive.

    ``versions`` has one row per key, ``period`` (the date valid time begins) and ``recorded``
    (date), with a bigint ``value``; it holds from the day after ``recorded`` until a later
    version of the period, and valid time runs until the next period that is known. A period that
    becomes known cuts only the region of the period before it, so there are at most two regions
    per version. Versions of equal day count in order of period; rows with a null in any column
    are left out.

    One pass over each key's versions in order of ``recorded``; held are only its known periods,
    whose number the calendar bounds, as it does the rows per key.
    """
    names = list(keys)
    rows = versions.select(*names, day_number(F.col(period)).alias("v"), day_number(F.col(recorded)).alias("r"), F.col(value).cast("bigint").alias("value")).dropna()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "value bigint, v0 int, v1 int, r0 int, r1 int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        starts: list[int] = []  # known periods of the key in order
        current: dict[int, list[int]] = {}  # period -> [value, end of valid time, start of recorded time]
        out: list[list] = [[] for _ in range(len(names) + 5)]

        def close(v: int, r: int) -> None:
            value, end, since = current[v]
            if since < r:
                for column, x in zip(out, (*held, value, v, end, since, r)):
                    column.append(x)

        def flush(kind: pa.Schema) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds_of(kind))], names=[*names, "value", "v0", "v1", "r0", "r1"])
            for x in out:
                x.clear()
            return batch

        def kinds_of(kind: pa.Schema) -> list[pa.DataType]:
            return [*[kind.field(n).type for n in names], pa.int64(), *[pa.int32()] * 4]

        kind = None
        for batch in batches:
            kind = batch.schema
            for *key, v, r, value in zip(*[c.to_pylist() for c in batch.columns]):
                key = tuple(key)
                if key != held:
                    for x in starts:
                        close(x, OPEN)
                    held, starts, current = key, [], {}
                since = r + 1
                if v in current:
                    close(v, since)
                    current[v] = [value, current[v][1], since]
                    continue
                at = bisect_left(starts, v)
                if at:
                    before = starts[at - 1]
                    close(before, since)
                    current[before] = [current[before][0], v, max(since, current[before][2])]
                current[v] = [value, starts[at] if at < len(starts) else OPEN, since]
                starts.insert(at, v)
            if len(out[0]) > 20_000:
                yield flush(kind)
        if held is not None:
            for x in starts:
                close(x, OPEN)
            yield flush(kind)

    return rows.repartition(*names).sortWithinPartitions(*names, "r", "v").mapInArrow(run, schema)


def _cells(low: Column, high: Column) -> Column:
    """The cells ``(width, cell)`` of an interval: at the least width that is not shorter, one or two."""
    choice = F.lit(None).cast("array<struct<width:int,cell:int>>")
    for w in reversed(WIDTHS):
        choice = F.when(high - low <= w, _at_width(low, high, w)).otherwise(choice)
    return choice


def _at_width(low: Column, high: Column, w: int) -> Column:
    return F.transform(F.sequence(F.floor(low / w).cast("int"), F.floor((high - 1) / w).cast("int")), lambda c: F.struct(F.lit(w).alias("width"), c.alias("cell")))


def _probes(point: Column, longest: int) -> Column:
    """The cell of a point at each width up to the first that is not below ``longest``."""
    widths = WIDTHS[: 1 + next(k for k, w in enumerate(WIDTHS) if w >= longest)]
    return F.array(*[F.struct(F.lit(w).alias("width"), F.floor(point / w).cast("int").alias("cell")) for w in widths])


def locate(points: DataFrame, regions: DataFrame, keys: Sequence[str], valid: str, recorded: str) -> DataFrame:
    """The ``value`` of the region each point ``(keys, valid, recorded)`` (days, int) lies in.

    Gives one row per distinct point that lies in a region; points with nulls lie in none. Where
    ``valid`` and ``recorded`` are the same column, only the diagonal of the plane matters and
    each region is reduced to its part of it before it is put into cells. Regions are cut off at the first
    and last day of the points, which are read first, so that few widths occur and are looked at.
    """
    names = list(keys)
    if valid == recorded:
        axes = [("a", F.greatest("v0", "r0"), F.least("v1", "r1"), valid)]
    else:
        axes = [("a", F.col("v0"), F.col("v1"), valid), ("b", F.col("r0"), F.col("r1"), recorded)]
    left, right = points.select(*names, *dict.fromkeys([valid, recorded])).dropna().distinct(), regions
    ends = points.agg(*[f(point) for *_, point in axes for f in (F.min, F.max)]).first()
    on = list(names)
    for k, (axis, low, high, point) in enumerate(axes):
        first, last = (0 if x is None else x for x in ends[2 * k : 2 * k + 2])
        right = right.withColumns({f"_{axis}0": F.greatest(low, F.lit(first)), f"_{axis}1": F.least(high, F.lit(last + 1))}).where(F.col(f"_{axis}0") < F.col(f"_{axis}1"))
        right = right.withColumn(f"_{axis}", F.explode(_cells(F.col(f"_{axis}0"), F.col(f"_{axis}1"))))
        left = left.withColumn(f"_{axis}", F.explode(_probes(F.col(point), last + 1 - first)))
        on.append(f"_{axis}")
    inside = F.lit(True)
    for axis, _, _, point in axes:
        inside &= (F.col(point) >= F.col(f"_{axis}0")) & (F.col(point) < F.col(f"_{axis}1"))
    found = left.join(right.select(*on, "value", *[f"_{a}{k}" for a, *_ in axes for k in (0, 1)]), on).where(inside)
    return found.select(*names, *dict.fromkeys([valid, recorded]), "value")
