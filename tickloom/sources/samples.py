"""Invented answers in the shapes of the public interfaces, to read without a network."""

from __future__ import annotations

from tickloom.sources.chain import topics

_DAY = 86_400
_LONG = "0x" + f"{123456789:064x}"
_HASH = "0x" + "ab" * 32


def _log(n: int, topic: str, data: str) -> dict:
    return {"address": "0x" + "11" * 20, "blockHash": _HASH, "blockNumber": hex(100 + n), "data": data, "logIndex": hex(n), "removed": False, "topics": [topic, "0x01"], "transactionHash": _HASH, "transactionIndex": "0x2"}


def _eth(first: int, last: int, logs: list[dict]) -> tuple[str, dict]:
    body = f'{{"jsonrpc": "2.0", "id": {(first - 100) // 5}, "method": "eth_getLogs", "params": [{{"address": "0x{"11" * 20}", "fromBlock": "{hex(first)}", "toBlock": "{hex(last)}"}}]}}'
    return f"http://127.0.0.1:8545{body}", {"result": logs}


# The addresses and the keys of the answers, as the public interfaces have them; all else is invented.
#: By source: options, and answers by address.
SAMPLES: dict[str, tuple[dict[str, str], dict[str, object]]] = {
    "yahoo_finance": (
        {"symbols": "AAA, BBB", "from": "2024-01-01", "to": "2024-01-04"},
        {
            f"https://query2.finance.yahoo.com/v8/finance/chart/{s}?period1=1704067200&period2=1704326400&interval=1d&events=history": {
                "chart": {"result": [{"timestamp": [1704067200 + k * _DAY for k in range(3)], "indicators": {"quote": [{"open": [p, p + 1, None], "high": [p + 2, p + 3, None], "low": [p - 1, p, None], "close": [p + 1, p + 2, None], "volume": [100, 200, None]}], "adjclose": [{"adjclose": [p + 0.9, p + 1.9, None]}]}}]}
            }
            for s, p in (("AAA", 10), ("BBB", 20))
        },
    ),
    "coingecko": ({"coin": "a-coin", "days": "1"}, {"https://api.coingecko.com/api/v3/coins/a-coin/ohlc?vs_currency=usd&days=1": [[1704067200000, 1.0, 2.0, 0.5, 1.5], [1704081600000, 1.5, 2.5, 1.0, 2.0]]}),
    "fred_series": ({"series": "AAA", "api_key": "k"}, {"https://api.stlouisfed.org/fred/series/observations?series_id=AAA&api_key=k&file_type=json": {"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-02-01", "value": "."}]}}),
    "polygon_aggs": (
        {"symbol": "AAA", "from": "2024-01-01", "to": "2024-01-02", "api_key": "k"},
        {"https://api.polygon.io/v2/aggs/ticker/AAA/range/1/day/2024-01-01/2024-01-02?adjusted=true&sort=asc&limit=50000&apiKey=k": {"results": [{"t": 1704067200000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 100, "vw": 1.2, "n": 7}, {"t": 1704153600000, "o": 2, "h": 3, "l": 1.5, "c": 2.5, "v": 50}]}},
    ),
    "binance_klines": ({"symbol": "AAABBB", "limit": "2"}, {"https://api.binance.com/api/v3/klines?symbol=AAABBB&interval=1d&limit=2": [[1704067200000, "1", "2", "0.5", "1.5", "10", 1704153599999, "15", 3, "0", "0", "0"], [1704153600000, "1.5", "2.5", "1", "2", "20", 1704239999999, "40", 4, "0", "0", "0"]]}),
    "alpha_vantage_news": (
        {"tickers": "AAA", "api_key": "k"},
        {
            "https://www.alphavantage.co/query?function=NEWS_SENTIMENT&tickers=AAA&apikey=k&limit=50": {
                "feed": [{"title": t, "url": "u", "time_published": at, "source": "s", "summary": "m", "overall_sentiment_score": 0.1, "overall_sentiment_label": "Neutral", "ticker_sentiment": [{"ticker": "AAA"}, {"ticker": "BBB"}]} for t, at in (("older", "20240101T120000"), ("newer", "20240102T120000"))]
            }
        },
    ),
    "sec_filings": (
        {"company": "aaa", "form": "10-K"},
        {
            "https://www.sec.gov/files/company_tickers_exchange.json": {"fields": ["cik", "name", "ticker", "exchange"], "data": [[9, "Another", "ZZZ", "X"], [42, "A Company", "AAA", "X"]]},
            "https://data.sec.gov/submissions/CIK0000000042.json": {"filings": {"recent": {"accessionNumber": ["0000-24-1", "0000-24-2"], "filingDate": ["2024-02-01", "2024-03-01"], "reportDate": ["2023-12-31", ""], "form": ["10-K", "8-K"], "primaryDocument": ["a.htm", "b.htm"]}}},
        },
    ),
    "sec_facts": (
        {"company": "CIK42", "concept": "Assets"},
        {"https://data.sec.gov/api/xbrl/companyconcept/CIK0000000042/us-gaap/Assets.json": {"units": {"USD": [{"val": 5, "end": "2022-12-31", "fy": 2022, "fp": "FY", "form": "10-K", "filed": "2023-02-01"}, {"val": 7, "end": "2023-12-31", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}, {"val": "none"}]}}},
    ),
    "read_eth": (
        {"address": "coin", "symbols": '{"COIN": "0x' + "11" * 20 + '"}', "from_block": "100", "to_block": "109", "blocks_per_request": "5"},
        dict([_eth(100, 104, [_log(0, topics()["Transfer"], _LONG), _log(1, topics()["Sync"], _LONG + "0" * 64)]), _eth(105, 109, [_log(2, "0xff", "0x")])]),
    ),
    "json_rpc": ({"url": "http://node.invalid/", "method": "eth_blockNumber"}, {"http://node.invalid/": {"jsonrpc": "2.0", "id": 1, "result": "0x10"}}),
}
