"""Problem 2: reported figures as known at the time of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bitemporal import day_number, locate, near_periods, rectangles
from tickloom.session import table

#: period_ends up to so many days apart are one period.
APART = 4


def same_concept(concept: Column) -> Column:
    """What is left of a concept without its prefix, case and all but letters and digits."""
    return F.regexp_replace(F.lower(F.regexp_replace(concept, r"^(?s).*:", "")), "[^a-z0-9]", "")


def p2_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of valid and recorded time in which a fact is the current one of its company and concept."""
    facts = table(spark, sf, "sec_facts").select("fact_id", "cik", same_concept(F.col("concept")).alias("concept"), "value", "period_end", "filed")
    known = F.when(F.col("value").isNotNull() & (F.col("filed") >= F.col("period_end")), F.col("filed"))
    # all facts count for the periods, those that can be a current version have a date of record
    dated = facts.where("cik IS NOT NULL AND concept IS NOT NULL AND period_end IS NOT NULL").groupBy("cik", "concept", "period_end", known.alias("known")).agg(F.min("fact_id").alias("fact_id"))
    versions = near_periods(dated, ["cik", "concept"], "period_end", APART, "period").where("known IS NOT NULL")
    versions = versions.groupBy("cik", "concept", "period", "known").agg(F.min("fact_id").alias("fact_id"))
    return rectangles(versions, ["cik", "concept"], "period", "known", "fact_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    signals = table(spark, sf, "trade_signals").select("signal_id", "cik", same_concept(F.col("concept")).alias("concept"), day_number(F.col("ts")).alias("day"))
    at = locate(signals, p2_regions(spark, sf), ["cik", "concept"], "day", "day")
    return signals.join(at, ["cik", "concept", "day"]).select("signal_id", F.col("value").alias("fact_id"))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Signals with the figure known at their time."""
    facts = table(spark, sf, "sec_facts").select("fact_id", "value", "period_end", "filed")
    return p2_found(spark, sf).join(facts, "fact_id").select("signal_id", "fact_id", "value", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("period_end", "filed")])


QUERIES = {"p2_found": p2_found, "p2_values": p2_values}

CONCEPT = "regexp_replace(lower(regexp_replace(concept, '^.*:', '', 's')), '[^a-z0-9]', '', 'g')"
_AS_OF = f"""WITH f AS (SELECT *, {CONCEPT} AS k FROM sec_facts WHERE cik IS NOT NULL AND concept IS NOT NULL AND period_end IS NOT NULL),
g AS (SELECT *, CASE WHEN period_end - lag(period_end) OVER w <= 4 THEN 0 ELSE 1 END AS b FROM f WINDOW w AS (PARTITION BY cik, k ORDER BY period_end)),
p AS (SELECT *, sum(b) OVER (PARTITION BY cik, k ORDER BY period_end) AS n FROM g),
s AS (SELECT signal_id, cik, ts, {CONCEPT} AS k FROM trade_signals WHERE ts IS NOT NULL),
best AS (SELECT signal_id, fact_id, value, period_end, filed FROM s JOIN p USING (cik, k)
 WHERE value IS NOT NULL AND filed IS NOT NULL AND filed >= period_end AND filed < CAST(ts AS DATE)
 QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY n DESC, filed DESC, fact_id) = 1)
"""
ORACLE = {
    "p2_found": _AS_OF + "SELECT signal_id, fact_id FROM best",
    "p2_values": _AS_OF + "SELECT signal_id, fact_id, value, strftime(period_end, '%Y-%m-%d') AS period_end, strftime(filed, '%Y-%m-%d') AS filed FROM best",
}
