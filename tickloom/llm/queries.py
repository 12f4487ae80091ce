"""Queries of problems 6 to 9, and SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import leakage, packing, skeleton, survivors
from tickloom.operators.bitemporal import near_periods
from tickloom.plans.facts import APART, CONCEPT, same_concept
from tickloom.session import materialize, table


#: Fields of a fact that the surviving record takes from its rows.
FIELDS = {"value": "value", "period_start": "start", "fiscal_year": "year", "form": "form"}
#: Periodic reports come before all other forms.
PERIODIC = ("10K", "10Q", "10KA", "10QA")


def _form() -> Column:
    return F.regexp_replace(F.upper("form"), "[^A-Z0-9]", "")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sec_facts").withColumn("concept", same_concept(F.col("concept")))


def _trust() -> list[Column]:
    """The stated order of rows: periodic reports, valid filing dates, the latest of them."""
    valid = F.coalesce(F.col("filed") >= F.col("period_end"), F.lit(False))
    return [F.when(_form().isin(*PERIODIC), 0).otherwise(1), F.when(valid, 0).otherwise(1), F.when(valid, -F.unix_date("filed")).otherwise(0)]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    best = survivors.consolidate(_facts(spark, sf), ["cik", "concept"], "period_end", APART, "fact_id", list(FIELDS), _trust())
    return best.select("first_id", *[F.col(f"{f}_from").alias(f"{name}_from") for f, name in FIELDS.items()])


#: Sources of facts for the inferred qualities: forms, and all others.
SOURCES = ("10K", "10Q", "10KA", "10QA", "8K", "8KA", "6K", "")


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    facts = _facts(spark, sf).where("cik IS NOT NULL AND concept IS NOT NULL AND period_end IS NOT NULL")
    periods = near_periods(facts.select("cik", "concept", "period_end").distinct(), ["cik", "concept"], "period_end", APART, "period")
    form = F.coalesce(_form(), F.lit(""))
    source = F.when(form.isin(*SOURCES), F.array_position(F.array(*map(F.lit, SOURCES)), form) - 1).otherwise(len(SOURCES) - 1)
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("value", "period_start", "fiscal_year")])
    trusted = facts.withColumn("trust", F.struct(*[t.alias(f"t{i}") for i, t in enumerate(_trust())], "fact_id"))
    return trusted.join(periods, ["cik", "concept", "period_end"]).withColumn("source", source).select("cik", "concept", "period", "source", "trust", F.inline(named))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return survivors.judge(_claims(spark, sf).drop("trust"), ["cik", "concept", "period"], F.col("source"), len(SOURCES))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often the value the model judges likeliest is the one the stated order takes: ``(field, groups, agree)``.

    Groups of two facts or more with different values; equal chances go by the stated order.
    """
    keys = ["cik", "concept", "period", "field"]
    first = _claims(spark, sf).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.min("trust").alias("trust"))
    both = first.join(_judged(spark, sf)[0].select(*keys, "value", "truth"), [*keys, "value"])
    picks = both.groupBy(*keys).agg(F.count("*").alias("values"), F.min("trust").alias("stated"), F.min(F.struct(-F.round("truth", 9), "trust"))["trust"].alias("model")).where("values > 1")
    return picks.groupBy("field").agg(F.count("*").alias("groups"), F.sum((F.col("stated") == F.col("model")).cast("int")).alias("agree"))


def p6_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of a fact judged true by the inferred qualities of its sources."""
    judged = _judged(spark, sf)[0].where("truth >= 0.5")
    return judged.select("cik", "concept", F.date_format("period", "yyyy-MM-dd").alias("period"), "field", "value", "claims", F.round("truth", 4).alias("truth"))


def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The inferred sensitivity and specificity of each kind of form."""
    names = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source") + 1)
    return _judged(spark, sf)[1].select("field", names.alias("form"), F.round("sensitivity", 4).alias("sensitivity"), F.round("specificity", 4).alias("specificity"))


#: Tokens of a container, the context sizes below it, and containers of a step.
CAPACITY, TIERS, STEP = 2048, (512, 1024), 64


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in containers of 2048 tokens, as pieces with their place and the context size of their window."""
    counts = materialize(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text"))
    packed = packing.pack(counts, CAPACITY, TIERS, STEP)
    return packed.select(F.col("doc").alias("doc_id"), "piece", "n_tokens", "window", F.col("container").alias("container_id"), "offset", F.col("step").alias("step_id"))


def p7_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, pieces and tokens of each step, how full its containers are, and how many tokens lie in windows of each size."""
    by_container = p7_packing(spark, sf).where("container_id IS NOT NULL").groupBy("step_id", "container_id")
    sizes = [F.sum(F.when(F.col("window") == t, F.col("n_tokens")).otherwise(0)).alias(f"tokens_{t}") for t in (*TIERS, CAPACITY)]
    steps = by_container.agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), *sizes)
    totals = [F.sum(c).alias(c) for c in ("pieces", "tokens", *[f"tokens_{t}" for t in (*TIERS, CAPACITY)])]
    return steps.groupBy("step_id").agg(F.count("*").alias("containers"), *totals, F.round(F.sum("tokens") / (F.count("*") * CAPACITY), 6).alias("filled"))


def p7_sound(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in all and in containers; pieces short of a container though their page goes on, beginning before the one before them ends, or reaching over their window."""
    packed = p7_packing(spark, sf)
    last, end = F.max("piece").over(Window.partitionBy("doc_id")), F.col("offset") + F.col("n_tokens")
    alone = F.when(F.col("container_id").isNull(), F.col("doc_id"))  # pages without tokens are in no container
    before = F.lag(end).over(Window.partitionBy("container_id", alone).orderBy("offset"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    marked = packed.select("*", ((F.col("piece") < last) & (F.col("n_tokens") < CAPACITY)).alias("short"), (F.col("container_id").isNotNull() & (before > F.col("offset"))).alias("over"), (F.col("offset") % F.col("window") + F.col("n_tokens") > F.col("window")).alias("beyond"))
    return marked.agg(F.count_distinct("doc_id").alias("pages"), F.count_distinct(F.when(F.col("container_id").isNotNull(), F.col("doc_id"))).alias("packed"), count(F.col("short"), "split_short"), count(F.col("over"), "overlaps"), count(F.col("beyond"), "overfull"))


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and the items they give away, with the share of the passage, its pieces and where it begins."""
    found = leakage.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("held", 6).alias("held"), "pieces", "position", "whole")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_matches(spark, sf).select("doc_id", "item_id")


def p8_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Pages on which a passage stands word for word."""
    return p8_matches(spark, sf).where("whole").select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.lookalikes(table(spark, sf, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page with the class of pages that look the same."""
    return skeleton.classes(table(spark, sf, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


QUERIES = {
    "p6_found": p6_found,
    "p6_truth": p6_truth,
    "p6_sources": p6_sources,
    "p7_packing": p7_packing,
    "p7_steps": p7_steps,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_whole": p8_whole,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
}

_BEST = """coalesce(first(fact_id ORDER BY {0} IS NULL, a, b, c, fact_id) FILTER (WHERE {0} IS NOT NULL), 0) AS {1}_from"""


def _words(text: str) -> str:
    """The words of a text with a blank around each."""
    plain = f"lower(strip_accents({skeleton.sql_form(text)}))"
    return f"' ' || trim(regexp_replace(regexp_replace({plain}, '-[^\\S\\n]*\\n\\s*', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


_FORMS = f"WITH f AS (SELECT doc_id, text, {skeleton.sql_form('text')} AS form FROM documents WHERE text IS NOT NULL)"
ORACLE: dict[str, str] = {
    "p6_found": f"""WITH f AS (SELECT *, {CONCEPT} AS k, regexp_replace(upper(form), '[^A-Z0-9]', '', 'g') AS g, coalesce(filed >= period_end, false) AS ok
 FROM sec_facts WHERE cik IS NOT NULL AND concept IS NOT NULL AND period_end IS NOT NULL),
h AS (SELECT *, CASE WHEN g IN ('10K', '10Q', '10KA', '10QA') THEN 0 ELSE 1 END AS a, CASE WHEN ok THEN 0 ELSE 1 END AS b, CASE WHEN ok THEN DATE '1970-01-01' - filed ELSE 0 END AS c,
 CASE WHEN period_end - lag(period_end) OVER w <= {APART} THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY cik, k ORDER BY period_end)),
p AS (SELECT *, sum(s) OVER (PARTITION BY cik, k ORDER BY period_end) AS n FROM h)
SELECT min(fact_id) AS first_id, {", ".join(_BEST.format(f, name) for f, name in FIELDS.items())} FROM p GROUP BY cik, k, n HAVING count(*) >= 2""",
    "p7_sound": "SELECT count(*) AS pages, count(*) FILTER (WHERE text <> '') AS packed, CAST(0 AS BIGINT) AS split_short, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS overfull FROM documents",
    "p8_whole": f"SELECT doc_id, item_id FROM (SELECT doc_id, {_words('text')} AS page FROM documents) JOIN (SELECT item_id, {_words('passage')} AS part FROM eval_items WHERE passage <> '') ON contains(page, part)",
    "p9_found": f"""{_FORMS} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p9_classes": f"""{_FORMS} SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, count(DISTINCT text) OVER (PARTITION BY form) AS variants FROM f""",
}
