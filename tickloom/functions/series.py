"""Ordered series as arrays, and folds over them.

``ordered`` gathers the rows of a group, or of a window frame, as an array in order of time.
Every builder over the same columns makes the same subtree, so Spark gathers it once however many
indicators are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

ColumnOrName = Column | str


def column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: ColumnOrName | float | None) -> Column:
    """A column, name or number as a double column."""
    return (c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)).cast("double")


def framed(aggregate: Column, over: WindowSpec | None) -> Column:
    return aggregate if over is None else aggregate.over(over)


def complete(value: Column, *needed: Column) -> Column:
    """``value`` where nothing needed is null."""
    test = F.lit(True)
    for c in needed:
        test = test & c.isNotNull()
    return F.when(test, value)


def ordered(ts: ColumnOrName, over: WindowSpec | None = None, **fields: ColumnOrName) -> Column:
    """The complete rows as ``array<struct<t, fields>>`` by ``t``; ties follow the fields."""
    t = column(ts)
    named = {k: number(c) for k, c in fields.items()}
    entry = complete(F.struct(t.alias("t"), *[c.alias(k) for k, c in named.items()]), t, *named.values())
    return F.array_sort(framed(F.collect_list(entry), over))


def tail(series: Column, n: int) -> Column:
    """The last ``n`` entries, or all if there are fewer."""
    return F.slice(series, F.greatest(F.lit(1), F.size(series) - n + 1), n)


def fold(series: Column, start: dict[str, object], step: Callable[[Column, Column], dict[str, Column]], finish: Callable[[Column], Column]) -> Column:
    """Fold with an accumulator of doubles; null for an empty series."""
    zero = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in start.items()])

    def merge(acc: Column, x: Column) -> Column:
        new = step(acc, x)
        return F.struct(*[new[k].cast("double").alias(k) for k in start])

    return F.when(F.size(series) > 0, F.aggregate(series, zero, merge, finish))


def positive(n: int, default: int) -> int:
    return n if n > 0 else default


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
