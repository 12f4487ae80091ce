"""Problem 1: quote blocks and chain logs as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.shred import ROOT, children, entities, objects, shred
from tickloom.session import materialize, table

QUOTE_FIELDS = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}
LOG_FIELDS = {"address": "string", "data": "string", "logIndex": "string", "removed": "boolean"}


def _quotes(nodes: DataFrame) -> DataFrame:
    return children(objects(nodes, ROOT), nodes, "quote").where(F.col("kind") == "object")


def _holders(nodes: DataFrame) -> DataFrame:
    """Receipts (entries of the document) and transactions (entries below it) by place."""
    roots = objects(nodes, ROOT)
    inner = children(roots, nodes, "transactions").where(F.col("kind") == "object")
    return roots.select("doc", "node", "ordinal").unionByName(inner.select("doc", "node", "ordinal"))


def _chart(spark: SparkSession, sf: str) -> DataFrame:
    """The whole adjacency table of the chart answers."""
    return materialize(shred(table(spark, sf, "yahoo_chart"), "response_id", "indicators"))


def _rpc(spark: SparkSession, sf: str) -> DataFrame:
    """The whole adjacency table of the node answers."""
    return materialize(shred(table(spark, sf, "json_rpc"), "rpc_id", "result"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    chart, rpc = _chart(spark, sf), _rpc(spark, sf)
    quotes = _quotes(chart).withColumnRenamed("ordinal", "parent_pos")
    closes = children(quotes, chart.where(F.col("kind") != "null"), "close", ["parent_pos"]).select(F.lit("yahoo_chart").alias("origin"), "doc", "parent_pos", "ordinal")
    holders = _holders(rpc).withColumnRenamed("ordinal", "parent_pos")
    logs = children(holders, objects_only(rpc), "logs", ["parent_pos"]).select(F.lit("json_rpc").alias("origin"), "doc", "parent_pos", "ordinal")
    return closes.unionByName(logs).select("origin", F.col("doc").alias("record_id"), "parent_pos", F.col("ordinal").alias("child_pos"))


def objects_only(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "object")


def p1_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of every quote block, with the key of the answer and the place of the block."""
    answers, nodes = table(spark, sf, "yahoo_chart"), _chart(spark, sf)
    quotes = _quotes(nodes)
    places = quotes.select("doc", "node", F.col("ordinal").alias("quote_pos"))
    bars = entities(quotes, nodes, QUOTE_FIELDS, by=["ordinal"])
    epochs = answers.select(F.col("response_id").alias("doc"), F.posexplode("epochs").alias("ordinal", "epoch")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
    return (
        bars.join(places, ["doc", "node"])
        .join(epochs, ["doc", "ordinal"], "left")
        .select(F.col("doc").alias("response_id"), "quote_pos", F.col("ordinal").alias("bar_pos"), "epoch", *QUOTE_FIELDS)
    )


def p1_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of every transaction and receipt with their scalar fields and number of topics."""
    nodes = _rpc(spark, sf)
    holders = _holders(nodes).withColumnRenamed("ordinal", "parent_pos")
    logs = children(holders, objects_only(nodes), "logs", ["parent_pos"])
    fields = entities(logs, nodes, LOG_FIELDS)
    topics = children(logs, nodes.where(F.col("kind") == "scalar"), "topics").groupBy("doc", F.col("parent").alias("node")).agg(F.count("*").alias("n_topics"))
    return (
        logs.select("doc", "node", "parent_pos", F.col("ordinal").alias("log_pos"))
        .join(fields, ["doc", "node"], "left")
        .join(topics, ["doc", "node"], "left")
        .select(F.col("doc").alias("rpc_id"), "parent_pos", "log_pos", "address", "data", F.col("logIndex").alias("log_index"), "removed", F.coalesce("n_topics", F.lit(0).cast("bigint")).alias("n_topics"))
    )


QUERIES = {"p1_found": p1_found, "p1_bars": p1_bars, "p1_logs": p1_logs}

#: A document as JSON: text that is incomplete is null, a document wrapped as a JSON string is unwrapped.
_DOCS = """
raw AS (SELECT {id} AS id, CASE WHEN json_valid({text}) THEN CAST({text} AS JSON) END AS j0 FROM {table}),
once AS (SELECT id, CASE WHEN json_type(j0) = 'VARCHAR' THEN CASE WHEN json_valid(j0 ->> '$') THEN CAST(j0 ->> '$' AS JSON) END ELSE j0 END AS j FROM raw)"""
_ENTRIES = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE CAST([] AS JSON[]) END"


def _entries(source: str, key: str, expr: str, carry: str) -> str:
    entries = _ENTRIES.format(expr)
    return f"SELECT {carry}, unnest({entries}) AS {key}, unnest(range(len({entries}))) AS {key}_pos FROM {source}"


_CHART = f"""WITH {_DOCS.format(id="response_id", text="indicators", table="yahoo_chart")},
quotes AS ({_entries("once", "q", "json_extract(j, '$.quote')", "id")})"""
_RPC = f"""{_DOCS.format(id="rpc_id", text="result", table="json_rpc")},
holders AS ({_entries("once", "h", "j", "id")} UNION ALL {_entries("once", "h", "json_extract(j, '$.transactions')", "id")}),
logs AS ({_entries("holders", "l", "json_extract(h, '$.logs')", "id, h_pos")})"""

ORACLE = {
    "p1_found": f"""{_CHART.replace("raw", "yraw").replace("once", "yonce")}, closes AS (
SELECT id, q_pos, unnest(CASE json_type(q, '$.close') WHEN 'ARRAY' THEN CAST(json_extract(q, '$.close') AS JSON[]) ELSE CAST([] AS JSON[]) END) AS c,
 unnest(range(CAST(CASE json_type(q, '$.close') WHEN 'ARRAY' THEN json_array_length(q, '$.close') ELSE 0 END AS BIGINT))) AS c_pos FROM quotes WHERE json_type(q) = 'OBJECT'), {_RPC}
SELECT 'yahoo_chart' AS origin, id AS record_id, CAST(q_pos AS BIGINT) AS parent_pos, CAST(c_pos AS BIGINT) AS child_pos FROM closes WHERE json_type(c) <> 'NULL'
UNION ALL SELECT 'json_rpc', id, CAST(h_pos AS BIGINT), CAST(l_pos AS BIGINT) FROM logs WHERE json_type(l) = 'OBJECT'""",
    "p1_bars": f"""{_CHART}, long AS (
SELECT id, q_pos, f, unnest(CASE json_type(q, '$.' || f) WHEN 'ARRAY' THEN CAST(json_extract(q, '$.' || f) AS JSON[]) ELSE CAST([] AS JSON[]) END) AS v,
 unnest(range(CAST(CASE json_type(q, '$.' || f) WHEN 'ARRAY' THEN json_array_length(q, '$.' || f) ELSE 0 END AS BIGINT))) AS pos
FROM quotes CROSS JOIN (SELECT unnest(['open','high','low','close','volume']) AS f) WHERE json_type(q) = 'OBJECT')
SELECT id AS response_id, CAST(q_pos AS BIGINT) AS quote_pos, CAST(pos AS BIGINT) AS bar_pos, max(epochs[pos + 1]) AS epoch,
 max(TRY_CAST(v ->> '$' AS DOUBLE)) FILTER (WHERE f = 'open') AS open, max(TRY_CAST(v ->> '$' AS DOUBLE)) FILTER (WHERE f = 'high') AS high,
 max(TRY_CAST(v ->> '$' AS DOUBLE)) FILTER (WHERE f = 'low') AS low, max(TRY_CAST(v ->> '$' AS DOUBLE)) FILTER (WHERE f = 'close') AS close,
 max(TRY_CAST(v ->> '$' AS BIGINT)) FILTER (WHERE f = 'volume') AS volume
FROM long JOIN yahoo_chart ON response_id = id GROUP BY ALL""",
    "p1_logs": f"""WITH {_RPC}
SELECT id AS rpc_id, CAST(h_pos AS BIGINT) AS parent_pos, CAST(l_pos AS BIGINT) AS log_pos, l ->> '$.address' AS address, l ->> '$.data' AS data,
 l ->> '$.logIndex' AS log_index, TRY_CAST(l ->> '$.removed' AS BOOLEAN) AS removed,
 CAST(CASE json_type(l, '$.topics') WHEN 'ARRAY' THEN json_array_length(l, '$.topics') ELSE 0 END AS BIGINT) AS n_topics
FROM logs WHERE json_type(l) = 'OBJECT'""",
}
