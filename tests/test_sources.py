import json
from datetime import date, datetime
from decimal import Decimal

import pytest

from tickloom.registry import read, register
from tickloom.sources.chain import keccak256, resolve, topics, word
from tickloom.sources.filings import SecFilings
from tickloom.sources.quotes import BinanceKlines, FredSeries, PolygonAggs, YahooFinance
from tickloom.sources.samples import SAMPLES


def rows(spark, name, **more):
    register(spark)
    options, answers = SAMPLES[name]
    return [tuple(r) for r in read(spark, name, **{**options, **more}, responses=json.dumps(answers)).collect()]


def test_quotes(spark):
    bars = rows(spark, "yahoo_finance")
    assert ("AAA", date(2024, 1, 1), 10.0, 12.0, 9.0, 11.0, 10.9, 100) in bars and ("BBB", date(2024, 1, 3), None, None, None, None, None, None) in bars and len(bars) == 6
    assert len(rows(spark, "yahoo_finance", arrays="true")) == 2
    assert rows(spark, "coingecko")[0] == (datetime(2024, 1, 1), 1.0, 2.0, 0.5, 1.5)
    assert rows(spark, "fred_series") == [(date(2024, 1, 1), 1.5, "AAA"), (date(2024, 2, 1), None, "AAA")]
    assert rows(spark, "polygon_aggs")[1] == (datetime(2024, 1, 2), 2.0, 3.0, 1.5, 2.5, 50.0, None, None)
    assert rows(spark, "binance_klines")[1][-2:] == (40.0, 4)
    assert [r[1] for r in rows(spark, "alpha_vantage_news")] == ["newer", "older"]


def test_filings(spark):
    assert rows(spark, "sec_filings") == [("0000-24-1", date(2024, 2, 1), date(2023, 12, 31), "10-K", "a.htm", "https://www.sec.gov/Archives/edgar/data/42/0000241/a.htm")]
    assert len(rows(spark, "sec_filings", form=None, limit=1)) == 1
    assert [r[2] for r in rows(spark, "sec_facts")] == [7.0, 5.0]
    with pytest.raises(Exception, match="no company"):
        rows(spark, "sec_filings", company="none")


def test_chain(spark):
    logs = sorted(rows(spark, "read_eth"), key=lambda r: r[6])
    assert [(r[1], r[3], r[4]) for r in logs] == [("Transfer", 100, [Decimal(123456789)]), ("Sync", 101, [Decimal(123456789), Decimal(0)]), ("Unknown", 102, [None])]
    assert logs[0][8] == ["0x01"]
    assert rows(spark, "json_rpc") == [("2.0", 1, '"0x10"', None)]
    assert keccak256(b"") == "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert topics()["Transfer"].startswith("0xddf252ad")
    assert word("0" * 64, True) == 0 and word("", True) is None and word("f" * 64, False) is None
    with pytest.raises(ValueError):
        word("f" * 64, True)
    with pytest.raises(ValueError, match="such as USDT"):
        resolve("USDX", {"USDT": "0x1", "WETH": "0x2"}, "address")
    assert resolve("usdt", {"USDT": "0x1"}, "address") == "0x1"


def test_only_wanted_columns_are_made(spark):
    assert rows(spark, "yahoo_finance", columns="close, symbol")[0] == (11.0, "AAA")
    assert sorted(rows(spark, "read_eth", columns="log_index,event_type")) == [(0, "Transfer"), (1, "Sync"), (2, "Unknown")]
    assert sorted((r[0] for r in rows(spark, "read_eth", columns="data")), key=len)[2] == [Decimal(123456789), Decimal(0)]
    with pytest.raises(Exception, match="no columns x"):
        rows(spark, "coingecko", columns="close,x")


@pytest.mark.parametrize(
    "source, options",
    [(YahooFinance, {"symbols": "A", "from": "2024-01-02", "to": "2024-01-01"}), (YahooFinance, {"symbols": "A", "from": "2024-01-01", "to": "2024-01-02", "interval": "2d"}), (BinanceKlines, {"symbol": "A", "limit": "1001"}), (PolygonAggs, {"symbol": "A", "from": "x", "to": "y", "multiplier": "0", "api_key": "k"}), (FredSeries, {"series": "A"}), (SecFilings, {})],
)
def test_options_are_checked(source, options):
    with pytest.raises(ValueError):
        source(options).check()


def test_ranges_are_split():
    one = YahooFinance({"symbols": "A,B", "from": "2024-01-01", "to": "2024-07-01"})
    spans = [r for r in one.requests() if r.about == "A"]
    assert len(spans) == 4 and len(one.requests()) == 8


def test_settings_give_keys(spark):
    options, answers = SAMPLES["fred_series"]
    spark.conf.set("tickloom.fred_api_key", "k")
    register(spark)
    assert read(spark, "fred_series", series="AAA", responses=json.dumps(answers)).count() == 2
    spark.conf.unset("tickloom.fred_api_key")
