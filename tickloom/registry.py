"""Make the library's names known to a session: ``register(spark)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions import pricing
from tickloom.functions.texts import BONDS, SCALARS
from tickloom.session import ship
from tickloom.sources.chain import EthLogs, JsonRpc
from tickloom.sources.filings import SecFacts, SecFilings
from tickloom.sources.quotes import AlphaVantageNews, BinanceKlines, CoinGecko, FredSeries, PolygonAggs, YahooFinance

SOURCES = (YahooFinance, CoinGecko, FredSeries, PolygonAggs, BinanceKlines, AlphaVantageNews, SecFilings, SecFacts, EthLogs, JsonRpc)


def register(spark: SparkSession) -> None:
    """Register the scalar functions for SQL and the data sources for ``spark.read.format``; again does no harm."""
    ship(spark)
    for name, (parameters, kind, body) in (SCALARS | BONDS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION timebucket(ts TIMESTAMP, width INTERVAL DAY TO SECOND) RETURNS TIMESTAMP RETURN timestamp_micros(unix_micros(ts) - unix_micros(ts) % CAST(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000 AS BIGINT))")
    for name, kernel in pricing.kernels().items():
        spark.udf.register(name, kernel)
    for source in SOURCES:
        spark.dataSource.register(source)


# Settings of the session and the option of a source each stands for.
SETTINGS = {
    "tickloom.eth_node_url": ("read_eth", "url"),
    "tickloom.eth_symbols": ("read_eth", "symbols"),
    "tickloom.fred_api_key": ("fred_series", "api_key"),
    "tickloom.polygon_api_key": ("polygon_aggs", "api_key"),
    "tickloom.alpha_vantage_api_key": ("alpha_vantage_news", "api_key"),
    "tickloom.sec_user_agent": ("sec_filings sec_facts", "user_agent"),
}


def read(spark: SparkSession, source: str, **options: object) -> DataFrame:
    """A data source with these options; keys and addresses not given come from the session's settings."""
    given = {k: str(v) for k, v in options.items() if v is not None}
    for setting, (sources, option) in SETTINGS.items():
        value = spark.conf.get(setting, None)
        if value and source in sources.split():
            given.setdefault(option, value)
    return spark.read.format(source).options(**given).load()
