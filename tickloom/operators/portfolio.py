"""Mean-variance portfolios and simulated price paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most assets of a portfolio: their covariances are solved on the driver.
MOST = 2_000


def moments(df: DataFrame, ts: str = "ts", symbol: str = "symbol", ret: str = "return") -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Symbols in order, mean returns, sample covariances and the number of times.

    ``df`` has one return per time and symbol, aligned by time; rows with nulls are left out.
    Raises ValueError for fewer than two symbols or times, for symbols with different numbers of
    returns or at different times, and for more than ``MOST`` symbols. Only numbers per symbol and
    per pair reach the driver.
    """
    rows = df.select(F.col(ts).alias("t"), F.col(symbol).cast("string").alias("s"), F.col(ret).cast("double").alias("r")).dropna()
    counts = rows.groupBy("s").agg(F.count("*").alias("n"), F.avg("r").alias("m")).orderBy("s").limit(MOST + 1).collect()
    if not 2 <= len(counts) <= MOST:
        raise ValueError(f"between 2 and {MOST} symbols")
    n = counts[0].n
    if any(c.n != n for c in counts) or n < 2:
        raise ValueError("all symbols need the same number of returns, at least two")
    place = {c.s: i for i, c in enumerate(counts)}
    mean = np.array([c.m for c in counts])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, whole = np.zeros((len(place), len(place))), True
        for batch in batches:
            for names, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = whole and len(names) == len(place) == len(set(names))
                if whole:
                    at = np.array([place[x] for x in names])
                    apart = np.zeros(len(place))
                    apart[at] = np.array(values) - mean[at]
                    total += np.outer(apart, apart)
        rows = [total[i].tolist() if whole else [] for i in range(len(place))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(place)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "x"])

    # the returns of one time, at most one per symbol, meet in one row; a task adds up the products of its times
    panel = rows.groupBy("t").agg(F.collect_list("s").alias("s"), F.collect_list("r").alias("r")).select("s", "r")
    parts = panel.mapInArrow(products, "i int, x array<double>")
    cov = np.zeros((len(place), len(place)))
    cells = parts.select("i", F.posexplode_outer("x").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    if cells.column("j").null_count:
        raise ValueError("symbols have returns at different times")
    cov[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy() / (n - 1)
    return list(place), mean, cov, float(n)


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse with a small ridge, so that collinear assets have one."""
    ridge = max(1e-10, abs(np.trace(cov)) * 1e-10 / len(cov))
    return np.linalg.inv(cov + ridge * np.eye(len(cov)))


def _portfolio(spark: SparkSession, symbols: list[str], w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> DataFrame:
    gain, risk = float(w @ mu), math.sqrt(max(0.0, float(w @ cov @ w)))
    return spark.createDataFrame([(s, float(x), gain, risk) for s, x in zip(symbols, w)], "symbol string, weight double, expected_return double, volatility double")


def min_variance_portfolio(df: DataFrame, ts: str = "ts", symbol: str = "symbol", ret: str = "return") -> DataFrame:
    """``(symbol, weight, expected_return, volatility)`` of the least variance; weights sum to 1 and may be below 0."""
    symbols, mu, cov, _ = moments(df, ts, symbol, ret)
    w = _inverse(cov) @ np.ones(len(mu))
    return _portfolio(df.sparkSession, symbols, w / w.sum(), mu, cov)


def max_sharpe_portfolio(df: DataFrame, rate: float = 0.0, ts: str = "ts", symbol: str = "symbol", ret: str = "return") -> DataFrame:
    """The portfolio with the best excess return by deviation; ValueError where it is not determined."""
    symbols, mu, cov, _ = moments(df, ts, symbol, ret)
    w = _inverse(cov) @ (mu - rate)
    if abs(w.sum()) < 1e-14:
        raise ValueError("the excess returns determine no portfolio")
    return _portfolio(df.sparkSession, symbols, w / w.sum(), mu, cov)


def efficient_frontier(df: DataFrame, points: int, rate: float = 0.0, ts: str = "ts", symbol: str = "symbol", ret: str = "return") -> DataFrame:
    """``(point_id, symbol, weight, expected_return, volatility, sharpe_ratio)`` at evenly spaced target returns.

    Targets run from the return of the least variance, or the least mean if that is lower, to the greatest mean.
    """
    if points < 2:
        raise ValueError("at least two points")
    symbols, mu, cov, _ = moments(df, ts, symbol, ret)
    inverse = _inverse(cov)
    basis = np.stack([np.ones(len(mu)), mu])
    system = basis @ inverse @ basis.T
    least = inverse @ basis[0]
    low, high = min(float(least / least.sum() @ mu), mu.min()), mu.max()
    if high - low < 1e-12:
        high = low + 1e-6
    rows = []
    if abs(np.linalg.det(system)) >= 1e-18:
        for k, target in enumerate(np.linspace(low, high, points)):
            w = inverse @ basis.T @ np.linalg.solve(system, np.array([1.0, target]))
            gain, risk = float(w @ mu), math.sqrt(max(0.0, float(w @ cov @ w)))
            rows += [(k, s, float(x), gain, risk, (gain - rate) / risk if risk else 0.0) for s, x in zip(symbols, w)]
    return df.sparkSession.createDataFrame(rows, "point_id int, symbol string, weight double, expected_return double, volatility double, sharpe_ratio double")


def monte_carlo(spark: SparkSession, start: float, mu: float, sigma: float, horizon: int, paths: int, seed: int = 42) -> DataFrame:
    """``(path_id, day, price)`` of geometric Brownian motion with 252 days a year; day 0 is ``start``.

    Each path has its own stream of random numbers, so that a result depends on the seed alone and
    paths spread over any number of tasks without a shuffle.
    """
    if start <= 0 or sigma < 0 or horizon <= 0 or paths <= 0:
        raise ValueError("start, horizon and paths must be above 0, sigma must not be below 0")
    drift, step = (mu - 0.5 * sigma**2) / 252, sigma / math.sqrt(252)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days = np.arange(horizon + 1, dtype=np.int32)
        several = max(1, 500_000 // (horizon + 1))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for some in np.array_split(ids, -(-len(ids) // several)) if len(ids) else []:
                noise = np.stack([np.random.Generator(np.random.Philox(key=seed % 2**64, counter=[0, 0, 0, int(i)])).standard_normal(horizon) for i in some])
                price = start * np.exp(np.concatenate([np.zeros((len(some), 1)), np.cumsum(drift + step * noise, axis=1)], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, horizon + 1)), pa.array(np.tile(days, len(some))), pa.array(price.ravel())], names=["path_id", "day", "price"])

    return spark.range(paths).mapInArrow(run, "path_id bigint, day int, price double")
