"""Readings that cannot be right against the usual behaviour of their own source.

Per source and measure a robust autoregression of the changes of the logarithm gives what the
readings before and after let expect. Two tests are repeated until neither finds more: a patch of up
to ``patch`` readings that departs from both sides is an additive outlier, taken out strongest first;
an element that departs from what came before, and whose level is kept by what follows, is a level
shift and begins a new stretch. Then the autoregression is fitted again without them, and the tests
are made anew. How far a departure must reach comes from the tail of the source's own departures,
but is never less than the measure's ``spike``. A patch at the very start is held against what
follows and the median of the next six elements alone. Runs of an equal value and impossible values
are tested apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.blocks import hot_keys, hot_places, in_blocks, joined_runs, sorted_groups, together
from tickloom.session import materialize

#: Bins of the mergeable histograms: logarithms of absolute changes, ratios of successive changes,
#: logarithms of departures in robust deviations.
_CHANGE = np.arange(-20.0, 20.01, 0.1)
_RATIO = np.arange(-2.0, 2.01, 0.05)
_DEPARTURE = np.arange(-5.0, 10.01, 0.05)
#: Stands for a null time.
_UNTIMED = -(2**62)


@dataclass(frozen=True)
class Measure:
    """One measured column: whether zero is possible, its least threshold in robust deviations, and the deviation of a source that hardly moves."""

    name: str
    zero: bool
    spike: float
    usual: float = 0.02


@dataclass(frozen=True)
class Limits:
    """``patch``: most readings of a spike. ``least``: least changes to fit by. A source with fewer, but ``few`` readings,
    is held against the measure's ``usual`` deviation and not tested for stuck runs; one with fewer readings
    gets only its impossible values flagged.

    A run of at least ``run`` equal non-zero readings is stuck if fewer than ``rare`` such runs
    are to be expected and it is ``longer`` times as long as the longest run that is not. Blocks of
    ``size`` rows and their ``margin`` say how sources are spread, not what is found.
    """

    patch: int = 3
    least: int = 10
    few: int = 20
    run: int = 5
    rare: float = 1e-4
    longer: float = 1.5
    size: int = 20_000
    margin: int = 500


@dataclass(frozen=True)
class Fit:
    """The autoregression of one source and measure, the threshold of a spike, the least length of a stuck run."""

    scale: float
    phi: float
    threshold: float
    least: float


def _median(histogram: np.ndarray, edges: np.ndarray, at_share: float = 0.5) -> float:
    """The median, or another quantile, of what a histogram counts."""
    total = histogram.sum()
    if not total:
        return float("nan")
    cumulative = np.cumsum(histogram)
    at = int(np.searchsorted(cumulative, total * at_share))
    before = cumulative[at] - histogram[at]
    return float(edges[at] + (edges[at + 1] - edges[at]) * (total * at_share - before) / histogram[at])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.r_[0, np.flatnonzero(np.diff(values)) + 1]
    return starts, np.diff(np.r_[starts, len(values)])


def _last_rows(ts: np.ndarray) -> np.ndarray:
    """Marks the last row of each reading."""
    return np.r_[ts[1:] != ts[:-1], True] if len(ts) else np.zeros(0, bool)


def _counted(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.histogram(np.clip(x, edges[0], edges[-1]), edges)[0]


def _changes(x: np.ndarray, mine: np.ndarray, shifted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the changes of ``x`` into the elements ``mine`` and of their ratios; a change that begins a level is none."""
    change = np.diff(x)
    usual = mine[1:] if shifted is None else mine[1:] & ~shifted[1:]
    pair = (change[:-1] != 0) & usual[1:]
    return _counted(np.log(np.abs(change[(change != 0) & usual])), _CHANGE), _counted(change[1:][pair] / change[:-1][pair], _RATIO)


def _lengths(values: np.ndarray) -> dict[int, int]:
    """The number of runs of a non-zero value by length."""
    if not len(values):
        return {}
    starts, n = _runs(values)
    kinds, counts = np.unique(n[values[starts] != 0], return_counts=True)
    return dict(zip(kinds.tolist(), counts.tolist()))


def _longest_usual(lengths: dict[int, int], limits: Limits) -> float:
    """The least length of a stuck run of this source; infinite if none of its runs is stuck.

    The chance that a run goes on comes from how many runs last at all where that is rare, else
    from the mean length beyond that without the longest runs.
    """
    kinds = np.array(sorted(lengths), dtype=float)
    if not len(kinds) or kinds[-1] < limits.run:
        return float("inf")
    counts = np.array([lengths[int(k)] for k in kinds], dtype=float)
    runs, lasting = counts.sum(), counts[kinds >= 2].sum()
    simple = (lasting + 0.5) / (runs + 1)
    if simple < 0.2:
        odds = np.log(runs) + (kinds - 1) * np.log(simple)
        stuck = (kinds >= limits.run) & (odds < np.log(limits.rare))
    else:
        tail, n = kinds[kinds >= 2] - 1, counts[kinds >= 2]
        spare = max(1.0, np.ceil(0.03 * lasting))
        cut = np.clip(np.cumsum(n[::-1])[::-1] - spare, 0, n)
        kept = cut.sum()
        mean = (cut * tail).sum() / kept if kept else 1.0
        # the mean without the longest runs is less than that of all by about their share of the tail
        share = spare / lasting
        mean += share * (1 - np.log(share)) * max(mean - 0.5, 0) if share < 1 else 0
        go_on = np.clip(1 - 1 / max(mean, 1.01), 0.01, 0.99)
        odds = np.log(lasting) + (kinds - 2) * np.log(go_on)
        stuck = (kinds >= limits.run) & (odds < np.log(limits.rare))
    # taken from the longest downwards, a stuck run must stand out from all that are not
    least = float("inf")
    for k in range(len(kinds) - 1, -1, -1):
        if not stuck[k]:
            break
        if k == 0 or kinds[k] >= limits.longer * kinds[k - 1]:
            least = kinds[k]
    return least


def _departures(t: np.ndarray, y: np.ndarray, shifted: np.ndarray, phi: float, patch: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the patch that begins at each element departs from what both sides let expect, and its length.

    A change that begins a level is not expected to go on.
    """
    n = len(y)
    reading = np.cumsum(np.r_[0, t[1:] != t[:-1]])
    usual = np.where(shifted[1:], 0, np.diff(y))
    ahead = np.r_[y[:1], y[1:] + phi * usual]  # what is expected after each element
    behind = np.r_[y[:-1] - phi * usual, y[-1:]]  # and before it
    best, length = np.zeros(n), np.zeros(n, int)
    low, high = y.copy(), y.copy()
    for k in range(1, 2 * patch + 1):
        m = n - k - 1  # patches of k elements from 1 on that have a neighbour on both sides
        if m < 1:
            break
        if k > 1:
            low, high = np.minimum(low[: n - k + 1], y[k - 1 :]), np.maximum(high[: n - k + 1], y[k - 1 :])
        before, after = ahead[:m], behind[k + 1 :]
        score = np.maximum(low[1 : m + 1] - np.maximum(before, after), np.minimum(before, after) - high[1 : m + 1])
        score[reading[k : k + m] - reading[1 : m + 1] >= patch] = 0
        better = score > best[1 : m + 1] * 1.0001
        best[1 : m + 1][better], length[1 : m + 1][better] = score[better], k
        if n >= k + 6 and t[0] > _UNTIMED and reading[k - 1] - reading[0] < patch:  # at the start only what follows tells
            first = max(low[0] - max(behind[k], y[k]), min(behind[k], y[k]) - high[0])
            if first > best[0] * 1.0001:
                best[0], length[0] = first, k
    return best, length


def _stands_out(y: np.ndarray, stretch: np.ndarray, first: int, length: int, by: float) -> bool:
    """Whether a patch departs from the middle of its wider neighbourhood too; a sound reading between two odd ones does not.

    The neighbourhood does not reach over a level shift unless fewer than three elements are left.
    """
    around = np.r_[max(0, first - 6) : first, first + length : min(len(y), first + length + 6)]
    level = around[stretch[around] == stretch[first]]
    return abs(np.median(y[first : first + length]) - np.median(y[level if len(level) > 2 else around])) > by


def _outliers(t: np.ndarray, x: np.ndarray, marked: np.ndarray, shifted: np.ndarray, fit: Fit, patch: int) -> bool:
    """Mark additive outliers among the elements until none is left; whether there were any."""
    any_found = False
    while True:
        at = np.flatnonzero(~marked)
        n = len(at)
        if n < 3:
            return any_found
        y, stretch = x[at], np.cumsum(shifted)[at]
        best, length = _departures(t[at], y, shifted[at], fit.phi, patch)
        candidates = [i for i in np.flatnonzero(best > fit.threshold) if _stands_out(y, stretch, i, length[i], max(best[i] / 2, 0.75 * fit.threshold))]
        if not candidates:
            return any_found
        any_found = True
        taken = np.full(n, False)
        for i in np.array(candidates)[np.argsort(-best[candidates], kind="stable")]:
            if not taken[max(0, i - 3) : i + length[i] + 3].any():
                marked[at[i : i + length[i]]] = True
                taken[max(0, i - 3) : i + length[i] + 3] = True


def _shifts(t: np.ndarray, x: np.ndarray, marked: np.ndarray, shifted: np.ndarray, fit: Fit, patch: int) -> bool:
    """Mark the first elements of new levels; whether there were any.

    The change into the element departs from what came before by the threshold, and so does the
    middle of the ``2 * patch + 1`` elements from it on from that of as many before, which they are nearer to
    than the old level. Next to each other only the largest change counts.
    """
    at = np.flatnonzero(~marked)
    wide = 2 * patch + 1
    y, stretch = x[at], np.cumsum(shifted)[at]
    n = len(y)
    if n < 2 * wide:
        return False
    change = np.abs(np.r_[0, 0, np.diff(y)[1:] - fit.phi * np.diff(y)[:-1]])
    found = False
    taken = np.zeros(n, bool)
    odd = np.flatnonzero((change > fit.threshold) & ~shifted[at])
    for i in odd[np.argsort(-change[odd], kind="stable")]:
        before, after = y[max(0, i - wide) : i][stretch[max(0, i - wide) : i] == stretch[i - 1]], y[i : i + wide]
        if len(before) < wide // 2 or len(after) < wide // 2 + 1 or taken[max(0, i - wide) : i + wide].any():
            continue
        level = np.median(after) - np.median(before)
        if abs(level) > fit.threshold and abs(y[i] - np.median(after)) < abs(level) / 2:
            shifted[at[i]] = taken[i] = found = True
    return found


def _marks(t: np.ndarray, x: np.ndarray, fit: Fit, patch: int) -> tuple[np.ndarray, np.ndarray]:
    """The additive outliers and the level shifts among the elements ``(t, x)``."""
    marked, shifted = np.zeros(len(x), bool), np.zeros(len(x), bool)
    while True:
        some = _outliers(t, x, marked, shifted, fit, patch)
        if not _shifts(t, x, marked, shifted, fit, patch) and not some:
            return marked, shifted
        if not shifted.any():
            return marked, shifted


class _Readings:
    """The possible values of one measure in order of time: rows, readings, and elements.

    A reading has one row or several; its last row is its value. An element is a value of a
    reading, however often it was fetched.
    """

    def __init__(self, ts: np.ndarray, value: np.ndarray, own: np.ndarray, measure: Measure):
        known = ~np.isnan(value)
        self.impossible = known & ((value < 0) if measure.zero else (value <= 0))
        self.rows = np.flatnonzero(known & ~self.impossible)
        self.ts, self.value, self.own = ts[self.rows], value[self.rows], own[self.rows]
        last = _last_rows(self.ts)
        self.rt, self.rv, self.mine = self.ts[last], self.value[last], self.own[last]
        self.order = np.lexsort((self.value, self.ts))
        t, v = self.ts[self.order], self.value[self.order]
        self.fresh = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])] if len(t) else np.zeros(0, bool)
        self.element = np.cumsum(self.fresh) - 1
        self.et, self.ev, self.emine = t[self.fresh], v[self.fresh], self.own[self.order][self.fresh]
        self.positive = np.flatnonzero(self.ev > 0)

    def first_look(self) -> tuple[np.ndarray, np.ndarray]:
        """Histograms of all changes of readings."""
        good = self.rv > 0
        return _changes(np.log(self.rv[good]), self.mine[good])

    def second_look(self, fit: Fit, patch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Histograms of the changes without outliers and shifts, and of the departures that are none."""
        t, x, mine = self.et[self.positive], np.log(self.ev[self.positive]), self.emine[self.positive]
        marked, shifted = _marks(t, x, fit, patch)
        left = ~marked
        t, x, mine, shifted = t[left], x[left], mine[left], shifted[left]
        one = _last_rows(t)
        sizes, ratios = _changes(x[one], mine[one], shifted[one])
        best = _departures(t, x, shifted, fit.phi, patch)[0] if len(x) > 2 else np.zeros(len(x))
        return sizes, ratios, _counted(np.log(best[mine & (best > 0)] / fit.scale), _DEPARTURE)

    def marks(self, fit: Fit, patch: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that carry an outlier, and those of which a new level begins."""
        out = []
        for some in _marks(self.et[self.positive], np.log(self.ev[self.positive]), fit, patch):
            bad = np.zeros(len(self.ev), bool)
            bad[self.positive] = some
            out.append(self.rows[self.order[bad[self.element]]])
        return out[0], out[1]

    def edges(self) -> tuple[dict[int, int], list[tuple[int, float, int]]]:
        """Of the own readings the lengths of runs within, and ``(side, value, length)`` of those at the edges."""
        v = self.rv[self.mine]
        if not len(v):
            return {}, []
        starts, n = _runs(v)
        sides = [(0, float(v[0]), int(n[0]))] + ([(1, float(v[-1]), int(n[-1]))] if len(n) > 1 else [])
        return _lengths(v[starts[1] : starts[-1]]) if len(n) > 2 else {}, sides

    def stuck(self, least: float, edges: dict[int, tuple[int, int]]) -> np.ndarray:
        """Rows of stuck runs but of their first readings; ``edges`` has by side what of the run is before this block, and its length."""
        t, v = self.rt[self.mine], self.rv[self.mine]
        if not len(v) or not np.isfinite(least):
            return np.zeros(0, int)
        starts, n = _runs(v)
        total, before = n.copy(), np.zeros(len(n), np.int64)
        for side, k in ((1, -1), (0, 0)):
            if side in edges and (side == 0 or len(n) > 1):
                before[k], total[k] = edges[side]
        out = [np.zeros(0, int)]
        for s, k, all_of_it, earlier in zip(starts, n, total, before):
            if all_of_it >= least and v[s] != 0:  # a reading carries on the run if any of its rows has the value
                inside = (self.ts >= t[s]) & (self.ts <= t[s + k - 1]) & (self.value == v[s])
                if not earlier:
                    inside &= self.ts > t[s]
                out.append(self.rows[inside])
        return np.concatenate(out)


def _first_fit(sizes: np.ndarray, ratios: np.ndarray, lengths: dict[int, int], measure: Measure, limits: Limits) -> Fit:
    """The fit from all changes and runs, or what stands for it with too few changes."""
    if sizes.sum() >= limits.least:
        return _fit(sizes, ratios, _longest_usual(lengths, limits), measure, limits)
    readings = sum(k * n for k, n in lengths.items())
    return Fit(measure.usual if readings >= limits.few else float("nan"), 0.0, measure.spike * measure.usual, float("inf"))


def _fit(sizes: np.ndarray, ratios: np.ndarray, least: float, measure: Measure, limits: Limits, departures: np.ndarray | None = None, scale_then: float = float("nan")) -> Fit:
    """Scale and coefficient from the histograms; with too few changes the scale stays as it was.

    The threshold is ``spike`` scales, or where the tail of the departures reaches further. The tail is that of
    a Weibull distribution through their 90 and 99 percent quantiles, taken so far out that one in ten
    such sources would have a departure beyond.
    """
    if sizes.sum() < limits.least:
        return Fit(scale_then, 0.0, measure.spike * scale_then, least)
    phi = float(np.clip(_median(ratios, _RATIO), -0.5, 0.5)) if ratios.sum() >= limits.least else 0.0
    scale = float(1.4826 * np.exp(_median(sizes, _CHANGE)) * np.sqrt(1 - phi * phi))
    tail = 0.0
    if departures is not None and departures.sum() >= 10 * limits.least:
        n = float(departures.sum())
        high, top = (_median(departures, _DEPARTURE, q) for q in (0.9, 0.99))
        tail = scale_then * np.exp(top + (top - high) / np.log(2) * np.log(np.log(10 * n) / np.log(100)))
    return Fit(scale, phi, float(max(measure.spike * scale, tail)), least)


def _fit_alone(r: _Readings, measure: Measure, limits: Limits) -> Fit:
    """The fit of a source that is one block."""
    first = _first_fit(*r.first_look(), _lengths(r.rv), measure, limits)
    if np.isnan(first.scale):
        return first
    sizes, ratios, departures = r.second_look(first, limits.patch)
    return _fit(sizes, ratios, first.least, measure, limits, departures, first.scale)


_KINDS = ["", "impossible", "spike", "stuck", "shift"]
_FLAGS = pa.schema([("row", pa.int64()), ("measure", pa.string()), ("kind", pa.string())])
#: What the rows of a look at a block tell: histogram bins, lengths of runs, runs at the edges, and what was given.
_SIZE, _RATIOS, _DEPARTED, _RUN, _EDGE, _GIVEN = range(6)
_LOOK = pa.schema([("key", pa.string()), ("measure", pa.int32()), ("what", pa.int32()), ("block", pa.int32()), ("side", pa.int32()), ("bin", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])
_LOOKED = "key string, measure int, what int, block int, side int, bin bigint, n bigint, value double"


def _judge(r: _Readings, size: int, limits: Limits, fit: Fit, edges: dict[int, tuple[int, int]]) -> np.ndarray:
    """For each row 0 or the number of what is wrong with it, or that a level shift begins there."""
    kind = np.zeros(size, np.int8)
    kind[r.impossible] = 1
    if len(r.rows) < 3 or np.isnan(fit.scale):
        return kind
    spikes, shifts = r.marks(fit, limits.patch)
    kind[shifts] = 4
    kind[spikes] = 2
    kind[r.stuck(fit.least, edges)] = 3
    return kind


def _arrays(group: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    columns = [group.column(n).cast(pa.float64()).to_numpy() for n in names]
    return group.column("ts").to_numpy(), group.column("own").to_numpy(), [c.astype(float) for c in columns]


def flag_readings(df: DataFrame, key: str, ts: str, row: str, order: Sequence[str], measures: Sequence[Measure], limits: Limits = Limits()) -> DataFrame:
    """Rows that carry a false value, ``(row, measure, kind)``: impossible, spike or stuck; and those at which a level ``shift`` begins, which are not false.

    Readings of a source ``key`` follow ``ts``; rows of one reading follow ``order`` and are judged
    each, as they may hold corrected values. Nulls are skipped, a null ``ts`` sorts first, null keys
    are one source; a source with few changes is held against a usual deviation, one with few readings gets
    only its impossible values flagged; repeated
    rows are flagged each, a null ``row`` as null; an empty table gives an empty one; other columns are ignored.

    Sources are spread over tasks by key, those with more than ``limits.size`` rows by blocks of
    that size with a margin of their neighbours. No task holds more than a block. Fits of such a
    source come from mergeable histograms over all its blocks, once with all readings and once
    without the outliers and shifts found by the first; runs are carried over the edges of blocks by
    their values and lengths there. Of all rows first only the keys are read; rows of hot keys are written
    for the looks, and all rows are read once more to be judged.
    """
    names = [m.name for m in measures]
    named = F.coalesce(F.concat(F.lit("k"), F.col(key)), F.lit(""))  # null keys are one key
    time = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(_UNTIMED))
    rows = df.select(named.alias("key"), time.alias("ts"), F.col(row).cast("bigint").alias("row"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(n).cast("double").alias(n) for n in names])
    hour = F.floor(F.col("ts") / 3_600_000_000)
    large = hot_keys(rows, "key", limits.size)
    sort = ["key", "block", "ts", *[f"_o{i}" for i in range(len(order))], "row"]
    columns = ["key", "block", "ts", "row", "own", *names]

    def told(group: pa.Table) -> tuple[list[Fit] | None, list[dict]]:
        """What is known of a block by its other blocks, from its first row: the fits, and the runs at its edges."""
        text = group.column("known")[0].as_py()
        if text is None:
            return None, []
        known = json.loads(text)
        given = [float(x) for x in known["given"]]
        return [Fit(*given[4 * k : 4 * k + 4]) for k in range(len(measures))], known.get("edges", [])

    def knowing(blocks: DataFrame, known: DataFrame) -> DataFrame:
        """The rows of blocks, each block led by a row without values that has in ``known`` what is known of it."""
        facts = [F.col(c) for c in known.columns if c not in ("key", "block")]
        lead = known.select("key", "block", F.lit(_UNTIMED - 1).alias("ts"), F.lit(False).alias("own"), F.to_json(F.struct(*facts)).alias("known"))
        return blocks.unionByName(lead, allowMissingColumns=True).repartition("key", "block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            at, own, values = _arrays(group, names)
            block = group.column("block")[0].as_py()
            fitted = told(group)[0] if "known" in group.column_names else None
            out: list[tuple] = []
            for k, (value, measure) in enumerate(zip(values, measures)):
                r = _Readings(at, value, own, measure)
                if fitted is None:
                    within, sides = r.edges()
                    out += [(k, _RUN, block, 0, length, n, None) for length, n in within.items()]
                    out += [(k, _EDGE, block, side, 0, n, v) for side, v, n in sides]
                    looks = r.first_look()
                else:
                    out += [(k, _GIVEN, block, 0, i, 1, float(x)) for i, x in enumerate((fitted[k].scale, fitted[k].least))]
                    looks = () if np.isnan(fitted[k].scale) else r.second_look(fitted[k], limits.patch)
                for what, histogram in enumerate(looks):
                    out += [(k, what, block, 0, int(i), int(histogram[i]), None) for i in np.flatnonzero(histogram)]
            if out:
                data = [pa.array([group.column("key")[0].as_py()] * len(out)), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(_LOOK)[1:]))]
                yield pa.RecordBatch.from_arrays(data, schema=_LOOK)

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for summary in batch.column(1).to_pylist():
                given: list[float] = []
                for k, measure in enumerate(measures):
                    histograms = [np.zeros(len(e) - 1) for e in (_CHANGE, _RATIO, _DEPARTURE)]
                    lengths, then = {}, {}
                    for x in summary:
                        if x["measure"] != k:
                            continue
                        if x["what"] == _RUN:
                            lengths[x["bin"]] = x["n"]
                        elif x["what"] == _GIVEN:
                            then[x["bin"]] = x["value"]
                        else:
                            histograms[x["what"]][x["bin"]] = x["n"]
                    sizes, ratios, departures = histograms
                    if then:
                        f = _fit(sizes, ratios, then[1], measure, limits, departures, then[0])
                    else:
                        f = _first_fit(sizes, ratios, lengths, measure, limits)
                    given += [f.scale, f.phi, f.threshold, f.least]
                out.append(given)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["key", "given"])

    def fitted(counts: DataFrame) -> DataFrame:
        """The fits of each hot key; all it gathers is a bounded number of bins and the lengths of runs."""
        bins = counts.groupBy("key", "measure", "what", "bin").agg(F.sum("n").alias("n"), F.max("value").alias("value"))
        return bins.groupBy("key").agg(F.collect_list(F.struct("measure", "what", "bin", "n", "value")).alias("summary")).mapInArrow(fitting, "key string, given array<double>")

    def looked(blocks: DataFrame, *more: str) -> DataFrame:
        return materialize(blocks.sortWithinPartitions(*sort).select(*columns, *more).mapInArrow(lambda batches: together(look(batches)), _LOOKED))

    alone = rows.select("*", F.lit(0).alias("block"), F.lit(True).alias("own"))
    if large.isEmpty():
        spread = alone.withColumn("known", F.lit(None).cast("string")).repartition("key")
    else:
        mine = F.col("key") == F.col("_key")
        stored = materialize(rows.join(large, mine, "left_semi"))
        hot = in_blocks(stored, hot_places(stored, "key", hour, limits.size, limits.margin), "key", hour)
        first = looked(hot.repartition("key", "block"))
        runs = joined_runs(first.where(F.col("what") == _EDGE), ["key", "measure"])
        ended = runs.where("value <> 0 AND before + n = total").select("key", "measure", F.lit(_RUN).alias("what"), F.col("total").alias("bin"), F.lit(1).cast("bigint").alias("n"), F.lit(None).cast("double").alias("value"))
        given = fitted(first.where(F.col("what") != _EDGE).select(*ended.columns).unionByName(ended))
        edges = runs.groupBy("key", "block").agg(F.collect_list(F.struct("measure", "side", "before", "total")).alias("edges"))
        known = materialize(edges.join(given, "key"))
        second = looked(knowing(hot, known.drop("edges")), "known")
        spread = knowing(alone.join(large, mine, "left_anti").unionByName(hot), known.drop("given").join(fitted(second), "key"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            at, own, values = _arrays(group, names)
            known, carried = told(group)
            for k, (value, measure) in enumerate(zip(values, measures)):
                r = _Readings(at, value, own, measure)
                fit = known[k] if known else _fit_alone(r, measure, limits)
                kind = _judge(r, len(value), limits, fit, {e["side"]: (e["before"], e["total"]) for e in carried if e["measure"] == k})
                bad = np.flatnonzero((kind > 0) & own)
                if len(bad):
                    yield pa.RecordBatch.from_arrays([group.column("row").take(pa.array(bad)).combine_chunks(), pa.array([measure.name] * len(bad)), pa.array([_KINDS[k] for k in kind[bad]])], schema=_FLAGS)

    return spread.sortWithinPartitions(*sort).select(*columns, "known").mapInArrow(lambda batches: together(judge(batches)), "row bigint, measure string, kind string")
