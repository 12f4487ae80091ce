"""Filings and reported figures of companies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, zip_longest
from typing import Any
from urllib.parse import quote

from tickloom.sources.rest import Request, RestSource, fetch, iso_date

_COMPANIES = "https://www.sec.gov/files/company_tickers_exchange.json"


class _Edgar(RestSource):
    """Options ``company`` (central index key, with or without CIK, or ticker) and ``user_agent``."""

    def headers(self) -> dict[str, str]:
        return {"User-Agent": self.options.get("user_agent", "") or "analytics admin@example.com"}

    def check(self) -> None:
        self.need("company")

    def address(self, cik: str) -> str:
        raise NotImplementedError

    def requests(self) -> list[Request]:
        # a ticker is looked up in the task: its partition begins with the list of companies
        given = self.options["company"].strip()
        if re.fullmatch(r"(?i:cik)?\s*\d{1,10}", given):
            cik = re.sub(r"\D", "", given).zfill(10)
            return [Request(self.address(cik), about=cik)]
        return [Request(_COMPANIES, about=None)]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        cik = request.about
        if cik is None:
            wanted = self.options["company"].strip().upper()
            found = next((r[0] for r in answer.get("data") or [] if len(r) > 2 and str(r[2]).upper() == wanted), None)
            if found is None:
                raise ValueError(f"{self.NAME}: no company has the ticker {wanted}")
            cik = str(found).zfill(10)
            answer = fetch(Request(self.address(cik)), dict(self.options), self.headers())
        return self.records(answer, cik)

    def records(self, answer: Any, cik: str) -> Iterator[tuple]:
        raise NotImplementedError


class SecFilings(_Edgar):
    """Latest filings of a company; further options ``form`` and ``limit`` (40)."""

    NAME = "sec_filings"
    SCHEMA = "accession_number string, filing_date date, report_date date, form string, primary_document string, url string"

    def check(self) -> None:
        super().check()
        self.whole("limit", 40, 1)

    def address(self, cik: str) -> str:
        return f"https://data.sec.gov/submissions/CIK{cik}.json"

    def records(self, answer: Any, cik: str) -> Iterator[tuple]:
        recent = (answer.get("filings") or {}).get("recent") or {}
        names = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
        n = len(recent.get(names[0]) or [])
        wanted = self.options.get("form")
        lines = zip_longest(*[(recent.get(k) or [])[:n] for k in names])
        made = (
            (number, iso_date(filed), iso_date(report), form or "", document or "", f"https://www.sec.gov/Archives/edgar/data/{int(cik)}/{number.replace('-', '')}/{document or ''}")
            for number, filed, report, form, document in lines
            if not wanted or form == wanted
        )
        return islice(made, int(self.options.get("limit", 40)))


class SecFacts(_Edgar):
    """Reported figures of a concept, latest filed first; further options ``concept``, ``taxonomy`` (us-gaap)."""

    NAME = "sec_facts"
    SCHEMA = "concept string, unit string, value double, period_start date, period_end date, fiscal_year int, fiscal_period string, form string, filed date"

    def check(self) -> None:
        super().check()
        self.need("concept")

    def address(self, cik: str) -> str:
        return f"https://data.sec.gov/api/xbrl/companyconcept/CIK{cik}/{quote(self.options.get('taxonomy', 'us-gaap'))}/{quote(self.options['concept'])}.json"

    def records(self, answer: Any, cik: str) -> Iterator[tuple]:
        out = []
        for unit, facts in (answer.get("units") or {}).items():
            for x in facts if isinstance(facts, list) else []:
                value, year = x.get("val"), x.get("fy")
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    continue
                out.append((self.options["concept"], unit, float(value), iso_date(x.get("start")), iso_date(x.get("end")), year if isinstance(year, int) else None, x.get("fp"), x.get("form"), iso_date(x.get("filed"))))
        return iter(sorted(out, key=lambda r: (r[-1] is not None, r[-1]), reverse=True))
