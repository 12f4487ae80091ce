"""The rows that the recorded answers of the data sources stand for, as SQL."""

from __future__ import annotations

from tickloom.sources.samples import SAMPLES

#: Microseconds of a day, and of the first of January 2024.
_DAY, _NEW_YEAR = 86_400_000_000, 1_704_067_200_000_000
_COIN, _HASH = "0x" + "11" * 20, "0x" + "ab" * 32
_NUMBER = f"{0x75BCD15:064x}"
_OHLC = "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"

#: By source: columns, and rows.
ROWS: dict[str, tuple[str, list[tuple]]] = {
    "yahoo_finance": (f"symbol VARCHAR, date VARCHAR, {_OHLC}, adj_close DOUBLE, volume BIGINT", [row for s, p in (("AAA", 10), ("BBB", 20)) for row in ((s, "2024-01-01", p, p + 2, p - 1, p + 1, p + 0.9, 100), (s, "2024-01-02", p + 1, p + 3, p, p + 2, p + 1.9, 200), (s, "2024-01-03", None, None, None, None, None, None))]),
    "coingecko": (f"timestamp_us BIGINT, {_OHLC}", [(_NEW_YEAR, 1, 2, 0.5, 1.5), (_NEW_YEAR + _DAY // 6, 1.5, 2.5, 1, 2)]),
    "fred_series": ("date VARCHAR, value DOUBLE, series_id VARCHAR", [("2024-01-01", 1.5, "AAA"), ("2024-02-01", None, "AAA")]),
    "polygon_aggs": (f"timestamp_us BIGINT, {_OHLC}, volume DOUBLE, vwap DOUBLE, transactions BIGINT", [(_NEW_YEAR, 1, 2, 0.5, 1.5, 100, 1.2, 7), (_NEW_YEAR + _DAY, 2, 3, 1.5, 2.5, 50, None, None)]),
    "binance_klines": (f"open_time_us BIGINT, {_OHLC}, volume DOUBLE, close_time_us BIGINT, quote_volume DOUBLE, trades BIGINT", [(_NEW_YEAR, 1, 2, 0.5, 1.5, 10, _NEW_YEAR + _DAY - 1000, 15, 3), (_NEW_YEAR + _DAY, 1.5, 2.5, 1, 2, 20, _NEW_YEAR + 2 * _DAY - 1000, 40, 4)]),
    "alpha_vantage_news": ("time_published_us BIGINT, title VARCHAR, url VARCHAR, source VARCHAR, summary VARCHAR, overall_sentiment_score DOUBLE, overall_sentiment_label VARCHAR, tickers VARCHAR", [(_NEW_YEAR + k * _DAY + _DAY // 2, t, "u", "s", "m", 0.1, "Neutral", "AAA BBB") for k, t in enumerate(("older", "newer"))]),
    "sec_filings": ("accession_number VARCHAR, filing_date VARCHAR, report_date VARCHAR, form VARCHAR, primary_document VARCHAR, url VARCHAR", [("0000-24-1", "2024-02-01", "2023-12-31", "10-K", "a.htm", "https://www.sec.gov/Archives/edgar/data/42/0000241/a.htm")]),
    "sec_facts": ("concept VARCHAR, unit VARCHAR, value DOUBLE, period_start VARCHAR, period_end VARCHAR, fiscal_year INTEGER, fiscal_period VARCHAR, form VARCHAR, filed VARCHAR", [("Assets", "USD", v, None, f"{y}-12-31", y, "FY", "10-K", f"{y + 1}-02-01") for v, y in ((5, 2022), (7, 2023))]),
    "read_eth": (
        "address VARCHAR, event_type VARCHAR, block_hash VARCHAR, block_number BIGINT, data VARCHAR, data_hex VARCHAR, log_index BIGINT, removed BOOLEAN, topics VARCHAR, transaction_hash VARCHAR, transaction_index BIGINT",
        [(_COIN, kind, _HASH, 100 + k, data, text, k, False, "0x01", _HASH, 2) for k, (kind, data, text) in enumerate((("Transfer", "123456789", "0x" + _NUMBER), ("Sync", "123456789 0", "0x" + _NUMBER + "0" * 64), ("Unknown", "", "0x")))],
    ),
    "json_rpc": ("jsonrpc VARCHAR, id BIGINT, result VARCHAR, error VARCHAR", [("2.0", 1, '"0x10"', None)]),
}
assert ROWS.keys() == SAMPLES.keys()


def _literal(value: object) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of typed columns."""
    named = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({c} AS {kind}) AS {c}' for c, kind in named)} FROM (VALUES {body}) AS t({', '.join(c for c, _ in named)})"


ORACLE = {f"source_{name}": values(*given) for name, given in ROWS.items()}
