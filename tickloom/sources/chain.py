"""Logs and single answers of a blockchain node."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from functools import cache
from typing import Any

from tickloom.sources.rest import Request, RestSource

_MASK = (1 << 64) - 1


@cache
def _round_constants() -> list[int]:
    out, state = [], 1
    for _ in range(24):
        constant = 0
        for k in range(7):
            if state & 1:
                constant |= 1 << ((1 << k) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(constant)
    return out


def _turn(x: int, n: int) -> int:
    n %= 64
    return ((x << n) | (x >> (64 - n))) & _MASK


def _permute(lanes: list[list[int]]) -> None:
    for constant in _round_constants():
        parity = [lanes[x][0] ^ lanes[x][1] ^ lanes[x][2] ^ lanes[x][3] ^ lanes[x][4] for x in range(5)]
        for x in range(5):
            mixed = parity[x - 1] ^ _turn(parity[(x + 1) % 5], 1)
            for y in range(5):
                lanes[x][y] ^= mixed
        x, y, held = 1, 0, lanes[1][0]
        for t in range(24):
            x, y = y, (2 * x + 3 * y) % 5
            held, lanes[x][y] = lanes[x][y], _turn(held, (t + 1) * (t + 2) // 2)
        for y in range(5):
            row = [lanes[x][y] for x in range(5)]
            for x in range(5):
                lanes[x][y] = row[x] ^ (~row[(x + 1) % 5] & row[(x + 2) % 5] & _MASK)
        lanes[0][0] ^= constant


def keccak256(data: bytes) -> str:
    """The hash of the chain's event signatures, as hex with 0x."""
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 1) % rate)
    padded[-1] |= 0x80
    lanes = [[0] * 5 for _ in range(5)]
    for a in range(0, len(padded), rate):
        for k in range(rate // 8):
            lanes[k % 5][k // 5] ^= int.from_bytes(padded[a + 8 * k : a + 8 * k + 8], "little")
        _permute(lanes)
    return "0x" + b"".join(lanes[k % 5][k // 5].to_bytes(8, "little") for k in range(4)).hex()


# The standard events and the types of their parameters.
EVENTS = {
    "Transfer": "address,address,uint256",
    "Approval": "address,address,uint256",
    "Sync": "uint112,uint112",
    "TransferSingle": "address,address,address,uint256,uint256",
    "TransferBatch": "address,address,address,uint256[],uint256[]",
    "ApprovalForAll": "address,address,bool",
    "Deposit": "address,uint256",
    "Withdrawal": "address,uint256",
}


@cache
def topics() -> dict[str, str]:
    """Topic hash of each event."""
    return {name: keccak256(f"{name}({kinds})".encode()) for name, kinds in EVENTS.items()}


def distance(a: str, b: str) -> int:
    """Edits between two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def resolve(name: str, known: dict[str, str], what: str) -> str:
    """The hex address of a name, in any case; ValueError with the nearest names if it is not known."""
    if name[:2].lower() == "0x":
        return name
    upper = {k.upper(): v for k, v in known.items()}
    if name.upper() in upper:
        return upper[name.upper()]
    near = sorted(known, key=lambda k: (distance(k.upper(), name.upper()), k))[:5]
    raise ValueError(f"unknown {what} {name!r}; it must be hex (0x...) or a known name" + (f", such as {', '.join(near)}" if near else ""))


def word(text: str, strict: bool) -> Decimal | None:
    """A hex number. Above 38 digits it is null, or an error if ``strict``; an empty one is null."""
    if not text:
        return None
    n = int(text, 16)
    if n < 10**38:
        return Decimal(n)
    if strict:
        raise ValueError(f"0x{text} has more than 38 digits")
    return None


class EthLogs(RestSource):
    """Logs of a contract by block range.

    Options: ``address`` (hex, or a name of ``symbols``, a JSON object of name to address or the
    path of one), ``topic`` (hex or name of an event, or none), ``from_block``, ``to_block``,
    ``blocks_per_request`` (-1: one request), ``strict`` (false), ``url``. One partition per range.
    """

    NAME = "read_eth"
    SCHEMA = "address string, event_type string, block_hash string, block_number bigint, data array<decimal(38,0)>, data_hex string, log_index bigint, removed boolean, topics array<string>, transaction_hash string, transaction_index bigint"

    def check(self) -> None:
        self.need("address", "from_block", "to_block")
        first = self.whole("from_block", 0, 0)
        self.whole("to_block", 0, first)
        self._place()

    def _place(self) -> tuple[str, str]:
        given = self.options.get("symbols", "{}")
        if not given.lstrip().startswith("{"):
            with open(given) as file:
                given = file.read()
        topic = self.options.get("topic", "")
        return resolve(self.options["address"], json.loads(given), "address"), resolve(topic, topics(), "topic") if topic else ""

    def requests(self) -> list[Request]:
        address, topic = self._place()
        first, last = int(self.options["from_block"]), int(self.options["to_block"])
        size = int(self.options.get("blocks_per_request", -1))
        size = size if size > 0 else last - first + 1
        url = self.options.get("url", "") or "http://127.0.0.1:8545"
        out = []
        for k, a in enumerate(range(first, last + 1, size)):
            wanted = {"address": address, **({"topics": [topic]} if topic else {}), "fromBlock": hex(a), "toBlock": hex(min(a + size - 1, last))}
            out.append(Request(url, json.dumps({"jsonrpc": "2.0", "id": k, "method": "eth_getLogs", "params": [wanted]})))
        return out

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        if "result" not in answer:
            raise OSError(f"the node answered {json.dumps(answer)[:300]}")
        strict = self.options.get("strict", "false").lower() == "true"
        names, decoded = {v: k for k, v in topics().items()}, self.wants("data")
        for x in answer["result"]:
            seen = x.get("topics") or []
            kind = names.get(seen[0], "Unknown") if seen else "Unknown"
            data = (x.get("data") or "0x")[2:]
            parts = [data[:64], data[64:128]] if kind == "Sync" else [data]
            values = [word(p, strict) for p in parts] if decoded else []
            yield x.get("address"), kind, x.get("blockHash"), _int(x.get("blockNumber")), values, x.get("data"), _int(x.get("logIndex")), bool(x.get("removed", False)), seen[1:], x.get("transactionHash"), _int(x.get("transactionIndex"))


def _int(text: str | None) -> int | None:
    return None if text is None else int(text, 16)


class JsonRpc(RestSource):
    """One call of a node; options ``url``, ``method``, ``params`` (a JSON list, empty). Result and error are JSON text."""

    NAME = "json_rpc"
    SCHEMA = "jsonrpc string, id bigint, result string, error string"

    def check(self) -> None:
        self.need("url", "method")
        if not isinstance(json.loads(self.options.get("params", "[]")), (list, dict)):
            raise ValueError("json_rpc: params must be a JSON list or object")

    def requests(self) -> list[Request]:
        body = {"jsonrpc": "2.0", "id": 1, "method": self.options["method"], "params": json.loads(self.options.get("params", "[]"))}
        return [Request(self.options["url"], json.dumps(body))]

    def rows(self, answer: Any, request: Request) -> Iterator[tuple]:
        text = lambda k: json.dumps(answer[k]) if answer.get(k) is not None else None
        yield answer.get("jsonrpc"), answer.get("id"), text("result"), text("error")
