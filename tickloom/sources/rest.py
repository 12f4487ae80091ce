"""Data sources that read one JSON answer per partition.

Planning only lists requests; answers are fetched in tasks. With the option ``responses`` they
come from a JSON object of address to answer instead of the network: the object itself, or the
path of a file that holds it. The option ``columns`` names the columns wanted; others are neither
made nor sent to Spark.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Between the columns of a schema, not within the brackets of a type.
_COLUMNS = re.compile(r",\s*(?![^(<]*[)>])")


@dataclass(frozen=True)
class Request:
    """An address, with a body for a POST; ``about`` is what the rows need to know of it."""

    url: str
    body: str | None = None
    about: Any = None


@dataclass
class _Partition(InputPartition):
    request: Request


def recorded(options: dict[str, str]) -> dict[str, Any] | None:
    given = options.get("responses")
    if not given:
        return None
    if given.lstrip().startswith("{"):
        return json.loads(given)
    with open(given) as file:
        return json.load(file)


def fetch(request: Request, options: dict[str, str], headers: dict[str, str] | None = None) -> Any:
    """The answer as parsed JSON; up to ``retries`` (3) more tries after errors that may pass."""
    answers = recorded(options)
    if answers is not None:
        key = request.url if request.body is None or request.url + request.body not in answers else request.url + request.body
        if key not in answers:
            raise OSError(f"no recorded answer for {key}")
        answer = answers[key]
        return json.loads(answer) if isinstance(answer, str) else answer
    tries = int(options.get("retries", 3))
    sent = urllib.request.Request(request.url, data=request.body.encode() if request.body is not None else None, headers={"Accept": "application/json", **({"Content-Type": "application/json"} if request.body is not None else {}), **(headers or {})})
    for k in range(tries + 1):
        try:
            with urllib.request.urlopen(sent, timeout=float(options.get("timeout", 30))) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if k == tries or e.code not in (429, 500, 502, 503, 504):
                raise
        except urllib.error.URLError:
            if k == tries:
                raise
        time.sleep(2**k)
    raise AssertionError


class RestSource(DataSource):
    """``requests`` lists what to fetch, ``rows`` makes tuples of an answer; both run on plain options."""

    NAME = ""
    SCHEMA = ""
    HEADERS: dict[str, str] = {}

    @classmethod
    def name(cls) -> str:
        return cls.NAME

    def every(self) -> str:
        """The schema with all columns."""
        return self.SCHEMA

    def schema(self) -> str:
        kinds = {c.split()[0]: c for c in _COLUMNS.split(self.every())}
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if unknown := set(wanted) - kinds.keys():
            raise ValueError(f"{self.NAME} has no columns {', '.join(sorted(unknown))}")
        return ", ".join(kinds[c] for c in wanted or kinds)

    def wants(self, column: str) -> bool:
        return column in {c.split()[0] for c in _COLUMNS.split(self.schema())}

    def reader(self, schema: Any) -> DataSourceReader:
        self.check()
        return _Reader(self)

    def check(self) -> None:
        """Raise ValueError for options that cannot be right."""

    def requests(self) -> list[Request]:
        raise NotImplementedError

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        raise NotImplementedError

    def headers(self) -> dict[str, str]:
        return self.HEADERS

    def need(self, *names: str) -> None:
        for n in names:
            if not self.options.get(n):
                raise ValueError(f"{self.NAME}: option {n} is needed")

    def whole(self, name: str, default: int, low: int, high: int | None = None) -> int:
        n = int(self.options.get(name, default))
        if n < low or (high is not None and n > high):
            raise ValueError(f"{self.NAME}: {name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))
        return n


class _Reader(DataSourceReader):
    def __init__(self, source: RestSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [_Partition(r) for r in self.source.requests()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        request = partition.request
        names = [c.split()[0] for c in _COLUMNS.split(self.source.every())]
        wanted = [names.index(c.split()[0]) for c in _COLUMNS.split(self.source.schema())]
        for row in self.source.rows(fetch(request, dict(self.source.options), self.source.headers()), request):
            yield tuple(row[k] for k in wanted)


def millis(x: Any) -> datetime | None:
    return None if x is None else datetime.fromtimestamp(int(x) / 1000, UTC)


def number(x: Any) -> float | None:
    """A number or text of one; None for other text, such as the dot that marks a missing value."""
    try:
        return None if x is None else float(x)
    except (TypeError, ValueError):
        return None


def whole(x: Any) -> int | None:
    n = number(x)
    return None if n is None else int(n)


def iso_date(x: Any) -> date | None:
    try:
        return date.fromisoformat(x) if x else None
    except (TypeError, ValueError):
        return None
