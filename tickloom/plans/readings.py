"""Problems 3 to 5: price readings by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.grid import regularize
from tickloom.operators.outliers import Measure, flag_readings
from tickloom.operators.rolling import latest, trailing_totals
from tickloom.session import table


def symbol() -> Column:
    """The symbol without blanks around it, in upper case."""
    return F.upper(F.trim("symbol"))


#: Least thresholds in robust deviations; volumes vary more and more evenly than prices.
MEASURES = (Measure("close", False, 8.0), Measure("adj_close", False, 8.0), Measure("volume", True, 5.0, usual=0.5))


def p4_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every false value with its column and what is wrong with it, and where level shifts begin."""
    readings = table(spark, sf, "yahoo_finance").withColumn("symbol", symbol())
    return flag_readings(readings, "symbol", "ts", "row_id", ["fetched_at"], MEASURES).withColumnRenamed("row", "row_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_flags(spark, sf).where("kind <> 'shift'").select("row_id").distinct()


def p4_impossible(spark: SparkSession, sf: str) -> DataFrame:
    """Values that cannot exist, with their column."""
    return p4_flags(spark, sf).where("kind = 'impossible'").select("row_id", "measure")


def p3_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Volume totals and average closes over 7 and 30 days, by symbol and calendar day."""
    rows = table(spark, sf, "yahoo_finance").select(symbol().alias("symbol"), "ts", "fetched_at", "row_id", "close", "volume").where("ts IS NOT NULL")
    readings = latest(rows, ["symbol", "ts"], ["fetched_at", "row_id"], ["close", "volume"])
    daily = readings.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.sum(F.when(F.col("volume") > 0, F.col("volume")).otherwise(0)).alias("v"), F.sum("close").alias("c"), F.count("close").alias("n")
    )
    totals = trailing_totals(daily, "symbol", "day", ["v", "c", "n"], [7, 30], tail=6)
    return totals.select(
        "symbol",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        *[F.col(f"v_{w}").cast("bigint").alias(f"volume_{w}") for w in (7, 30)],
        # closes have 4 digits, so means lie on ties of the rounding; the shift settles them upwards
        *[F.round(F.try_divide(F.col(f"c_{w}"), F.col(f"n_{w}")) + 1e-9, 4).alias(f"close_{w}") for w in (7, 30)],
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_rolling(spark, sf).where("2 * volume_7 > volume_30 AND volume_30 > volume_7").select("symbol", "day")


#: Longer gaps are interruptions.
GAP = 20


def _closes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "yahoo_finance").select(symbol().alias("series"), "date", "ts", "fetched_at", "row_id", "close")
    return regularize(rows, "series", "date", "close", F.lit("D"), ["ts", "fetched_at", "row_id"], GAP)


def _series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fred_series").select(F.col("series_id").alias("series"), "freq", "date", "value", "fetched_at", "obs_id")
    return regularize(rows, "series", "date", "value", F.col("freq"), ["fetched_at", "obs_id"], GAP)


def p5_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every weekday of a symbol and every period of a series, missing ones marked and filled."""
    parts = [grid.select(F.lit(origin).alias("origin"), "*") for origin, grid in (("yahoo_finance", _closes(spark, sf)), ("fred_series", _series(spark, sf)))]
    both = parts[0].unionByName(parts[1])
    return both.select("origin", "series", F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 4).alias("value"), "missing", "run", F.round(F.col("filled") + 1e-10, 6).alias("filled"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_grid(spark, sf).where(F.col("missing") & (F.col("run") <= GAP)).select("origin", "series", "period")


QUERIES = {"p3_found": p3_found, "p3_rolling": p3_rolling, "p4_found": p4_found, "p4_flags": p4_flags, "p4_impossible": p4_impossible, "p5_found": p5_found, "p5_grid": p5_grid}

_ROLLING = """WITH readings AS (
 SELECT upper(trim(symbol)) AS s, ts, close, greatest(coalesce(volume, 0), 0) AS v FROM yahoo_finance WHERE ts IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY upper(trim(symbol)), ts ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1),
daily AS (SELECT s, CAST(ts AS DATE) AS d, sum(v) AS v, sum(close) AS c, count(close) AS n FROM readings GROUP BY ALL),
days AS (SELECT s, CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY s),
rolled AS (SELECT s, d, sum(v) OVER w7 AS v7, sum(v) OVER w30 AS v30, sum(c) OVER w7 AS c7, sum(n) OVER w7 AS n7, sum(c) OVER w30 AS c30, sum(n) OVER w30 AS n30
 FROM days LEFT JOIN daily USING (s, d)
 WINDOW w7 AS (PARTITION BY s ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY s ORDER BY d ROWS 29 PRECEDING))
"""
_PERIODS = """
q AS (SELECT 'yahoo_finance' AS origin, upper(trim(symbol)) AS s, 'D' AS freq, date AS d, close AS v, ts AS o1, fetched_at AS o2, row_id AS o3 FROM yahoo_finance
 UNION ALL SELECT 'fred_series', series_id, freq, date, value, NULL, fetched_at, obs_id FROM fred_series),
r AS (SELECT *, CASE freq WHEN 'D' THEN CASE WHEN isodow(d) < 6 THEN d END
  WHEN 'W' THEN date_trunc('week', d) WHEN 'M' THEN date_trunc('month', d) WHEN 'Q' THEN date_trunc('quarter', d) END AS p
 FROM q WHERE v IS NOT NULL AND d IS NOT NULL AND s IS NOT NULL),
present AS (SELECT origin, s, freq, CAST(p AS DATE) AS p, v, d FROM r WHERE p IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY origin, s, freq, p ORDER BY d DESC, o1 DESC NULLS LAST, o2 DESC NULLS LAST, o3 DESC) = 1),
points AS (SELECT origin, s, freq, CAST(unnest(generate_series(CAST(min(p) AS TIMESTAMP), CAST(max(p) AS TIMESTAMP),
  CASE freq WHEN 'D' THEN INTERVAL 1 DAY WHEN 'W' THEN INTERVAL 7 DAY WHEN 'M' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END)) AS DATE) AS p FROM present GROUP BY origin, s, freq),
grid AS (SELECT points.*, v, d, count(v) OVER (PARTITION BY origin, s, freq ORDER BY points.p) AS g
 FROM points LEFT JOIN present USING (origin, s, freq, p) WHERE freq <> 'D' OR isodow(points.p) <= 5),
runs AS (SELECT origin, s, freq, p, v, v IS NULL AS missing, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY origin, s, freq, g) AS run,
 max(v) OVER (PARTITION BY origin, s, freq, g) AS va, max(d) OVER (PARTITION BY origin, s, freq, g) AS da, g FROM grid),
heads AS (SELECT origin, s, freq, g - 1 AS g, v AS vb, d AS db FROM grid WHERE v IS NOT NULL)
"""

ORACLE = {
    "p4_impossible": """SELECT row_id, measure FROM (SELECT row_id, unnest(['close', 'adj_close', 'volume']) AS measure, unnest([close <= 0, adj_close <= 0, volume < 0]) AS bad FROM yahoo_finance) WHERE bad""",
    "p3_found": _ROLLING + "SELECT s AS symbol, strftime(d, '%Y-%m-%d') AS day FROM rolled WHERE 2 * v7 > v30 AND v30 > v7",
    "p3_rolling": _ROLLING
    + """SELECT s AS symbol, strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(v7, 0) AS BIGINT) AS volume_7, CAST(coalesce(v30, 0) AS BIGINT) AS volume_30,
 round(c7 / nullif(n7, 0) + 1e-9, 4) AS close_7, round(c30 / nullif(n30, 0) + 1e-9, 4) AS close_30 FROM rolled""",
    "p5_found": "WITH " + _PERIODS + f"SELECT origin, s AS series, strftime(p, '%Y-%m-%d') AS period FROM runs WHERE missing AND run <= {GAP}",
    "p5_grid": "WITH "
    + _PERIODS
    + f"""SELECT origin, s AS series, strftime(p, '%Y-%m-%d') AS period, round(v, 4) AS value, missing, CASE WHEN missing THEN run ELSE 0 END AS run,
 round(CASE WHEN NOT missing THEN v WHEN run <= {GAP} THEN va + (vb - va) * greatest(0, least(1, CAST(p - da AS DOUBLE) / (db - da))) END + 1e-10, 6) AS filled
FROM runs LEFT JOIN heads USING (origin, s, freq, g)""",
}
