"""Prices, series and news from public web interfaces."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import zip_longest
from typing import Any
from urllib.parse import quote, urlencode

from tickloom.sources.rest import Request, RestSource, iso_date, millis, number, whole

# The intervals the chart interface knows, in days.
_INTERVALS = {"1d": 1, "5d": 5, "1wk": 7, "1mo": 30, "3mo": 90}
_DAY = 86_400
#: About so many bars are asked for at once.
_BARS = 60


def _epoch(text: str) -> int:
    t = datetime.fromisoformat(text)
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())


class YahooFinance(RestSource):
    """Bars by symbol; options ``symbols`` (with commas), ``from``, ``to``, ``interval`` (1d), ``arrays`` (false).

    One partition per symbol and span of about 60 bars. Rows are bars; with ``arrays`` one row per
    request holds them as arrays.
    """

    NAME = "yahoo_finance"
    _FIELDS = ("open", "high", "low", "close", "adj_close", "volume")

    def every(self) -> str:
        if self.options.get("arrays", "false").lower() == "true":
            return "symbol string, date array<date>, open array<double>, high array<double>, low array<double>, close array<double>, adj_close array<double>, volume array<bigint>"
        return "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint"

    def check(self) -> None:
        self.need("symbols", "from", "to")
        if self.options.get("interval", "1d") not in _INTERVALS:
            raise ValueError(f"yahoo_finance: interval must be one of {', '.join(_INTERVALS)}")
        if _epoch(self.options["to"]) <= _epoch(self.options["from"]):
            raise ValueError("yahoo_finance: to must be after from")

    def requests(self) -> list[Request]:
        interval = self.options.get("interval", "1d")
        step = _INTERVALS[interval] * _BARS * _DAY
        start, end = _epoch(self.options["from"]), _epoch(self.options["to"])
        out = []
        for symbol in filter(None, (s.strip() for s in self.options["symbols"].split(","))):
            for a in range(start, end, step):
                query = urlencode({"period1": a, "period2": min(a + step, end), "interval": interval, "events": "history"})
                out.append(Request(f"https://query2.finance.yahoo.com/v8/finance/chart/{quote(symbol)}?{query}", about=symbol))
        return out

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        result = ((answer.get("chart") or {}).get("result") or [None])[0]
        if not result or not result.get("timestamp"):
            return
        indicators = result.get("indicators") or {}
        bars = (indicators.get("quote") or [{}])[0]
        adjusted = (indicators.get("adjclose") or [{}])[0].get("adjclose") or []
        dates = [datetime.fromtimestamp(t, UTC).date() for t in result["timestamp"]]
        columns = [[number(x) for x in bars.get(f) or []] for f in ("open", "high", "low", "close")]
        columns += [[number(x) for x in adjusted], [whole(x) for x in bars.get("volume") or []]]
        if self.options.get("arrays", "false").lower() == "true":
            yield (request.about, dates, *columns)
        else:
            for day, *values in zip_longest(dates, *[c[: len(dates)] for c in columns]):
                yield (request.about, day, *values)


class CoinGecko(RestSource):
    """Bars of a coin; options ``coin``, ``vs`` (usd), ``days`` (30)."""

    NAME = "coingecko"
    SCHEMA = "timestamp timestamp, open double, high double, low double, close double"

    def check(self) -> None:
        self.need("coin")
        self.whole("days", 30, 1)

    def requests(self) -> list[Request]:
        o = self.options
        return [Request(f"https://api.coingecko.com/api/v3/coins/{quote(o['coin'])}/ohlc?vs_currency={quote(o.get('vs', 'usd'))}&days={int(o.get('days', 30))}")]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        for t, *prices in answer:
            yield (millis(t), *map(number, prices[:4]))


class FredSeries(RestSource):
    """Observations of series; options ``series`` (with commas), ``api_key``, ``start``, ``end``. A dot is null."""

    NAME = "fred_series"
    SCHEMA = "date date, value double, series_id string"

    def check(self) -> None:
        self.need("series")
        if not self.options.get("api_key", ""):
            raise ValueError("fred_series: option api_key is needed")

    def requests(self) -> list[Request]:
        key = self.options.get("api_key", "")
        more = {f"observation_{n}": self.options[n] for n in ("start", "end") if self.options.get(n)}
        ids = [s.strip() for s in self.options["series"].split(",") if s.strip()]
        return [Request("https://api.stlouisfed.org/fred/series/observations?" + urlencode({"series_id": s, "api_key": key, "file_type": "json", **more}), about=s) for s in ids]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        for x in answer.get("observations") or []:
            yield iso_date(x.get("date")), number(x.get("value")), request.about


class PolygonAggs(RestSource):
    """Bars of a symbol; options ``symbol``, ``multiplier`` (1), ``timespan`` (day), ``from``, ``to``, ``api_key``."""

    NAME = "polygon_aggs"
    SCHEMA = "timestamp timestamp, open double, high double, low double, close double, volume double, vwap double, transactions bigint"

    def check(self) -> None:
        self.need("symbol", "from", "to")
        self.whole("multiplier", 1, 1)
        if not self.options.get("api_key", ""):
            raise ValueError("polygon_aggs: option api_key is needed")

    def requests(self) -> list[Request]:
        o = self.options
        span = f"{int(o.get('multiplier', 1))}/{quote(o.get('timespan', 'day'))}/{quote(o['from'])}/{quote(o['to'])}"
        query = urlencode({"adjusted": "true", "sort": "asc", "limit": 50000, "apiKey": o.get("api_key", "")})
        return [Request(f"https://api.polygon.io/v2/aggs/ticker/{quote(o['symbol'])}/range/{span}?{query}")]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        for x in answer.get("results") or []:
            yield (millis(x.get("t")), *[number(x.get(k)) for k in ("o", "h", "l", "c", "v", "vw")], whole(x.get("n")))


class BinanceKlines(RestSource):
    """Latest bars of a pair; options ``symbol``, ``interval`` (1d), ``limit`` (500, at most 1000)."""

    NAME = "binance_klines"
    SCHEMA = "open_time timestamp, open double, high double, low double, close double, volume double, close_time timestamp, quote_volume double, trades bigint"

    def check(self) -> None:
        self.need("symbol")
        self.whole("limit", 500, 1, 1000)

    def requests(self) -> list[Request]:
        o = self.options
        return [Request("https://api.binance.com/api/v3/klines?" + urlencode({"symbol": o["symbol"], "interval": o.get("interval", "1d"), "limit": int(o.get("limit", 500))}))]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        for x in answer:
            yield (millis(x[0]), *map(number, x[1:6]), millis(x[6]), number(x[7]), whole(x[8]))


class AlphaVantageNews(RestSource):
    """News with sentiment, newest first; options ``tickers``, ``from``, ``to``, ``limit`` (50, at most 1000), ``api_key``."""

    NAME = "alpha_vantage_news"
    SCHEMA = "time_published timestamp, title string, url string, source string, summary string, overall_sentiment_score double, overall_sentiment_label string, tickers array<string>"

    def check(self) -> None:
        self.need("tickers")
        self.whole("limit", 50, 1, 1000)
        if not self.options.get("api_key", ""):
            raise ValueError("alpha_vantage_news: option api_key is needed")

    def requests(self) -> list[Request]:
        o = self.options
        more = {f"time_{n}": o[n] for n in ("from", "to") if o.get(n)}
        query = {"function": "NEWS_SENTIMENT", "tickers": o["tickers"], "apikey": o.get("api_key", ""), "limit": int(o.get("limit", 50)), **more}
        return [Request("https://www.alphavantage.co/query?" + urlencode(query))]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        feed = [(datetime.strptime(x["time_published"], "%Y%m%dT%H%M%S").replace(tzinfo=UTC), x) for x in answer.get("feed") or []]
        for t, x in sorted(feed, key=lambda p: p[0], reverse=True):
            tickers = [y.get("ticker") for y in x.get("ticker_sentiment") or []]
            yield t, x.get("title"), x.get("url"), x.get("source"), x.get("summary"), number(x.get("overall_sentiment_score")), x.get("overall_sentiment_label"), tickers
