"""Passages of held-out test items inside a corpus, by a positional inverted index of the corpus.

Every word of every document is stored in inverted lists ``(term, page, position)``, one row for each
block of pages, so that no term gathers its documents, a frequent term is split by page block, and
nothing of a text is shuffled. The passages, a table of known size, go to every block. There the
lists of a phrase's terms are intersected after adjusting by their offsets, from the list of the term
that is rarest in the whole corpus on; that gives the places of exact phrases. What a document has of
a passage is put together from them by proximity: phrases that follow each other in document and passage
make a piece, across other matter of limited length, and words beside or between them are looked up
in their lists.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.skeleton import prototypes
from tickloom.session import materialize

_BREAK = re.compile(r"-[^\S\n]*\n\s*")
_WORD = re.compile(r"[^\W_]+")
# Characters that print readers confuse, by one that stands for all of its group.
_CONFUSED = str.maketrans("c0ovu1j58hqf", "eaarnlisbbgt")
_JOINED = (("vv", "w"), ("rn", "m"), ("cl", "d"))
#: Prototypes of characters, and no accents.
_PLAIN = prototypes() | {c: None for c in range(0x300, 0x1_F000) if unicodedata.combining(chr(c))}
#: Bits of a posting: term, page within its block, position within its page.
_TERM, _PAGE, _AT = 20, 14, 28
#: Postings intersected at once, to bound memory.
_AT_ONCE = 500_000


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation and hyphen breaks."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_PLAIN)
    return _WORD.findall(_BREAK.sub("", text.lower()))


@lru_cache(1 << 18)
def alike(word: str) -> str:
    """One form for the words that a print reader confuses."""
    for odd, usual in _JOINED:
        word = word.replace(odd, usual)
    return word.translate(_CONFUSED)


@dataclass(frozen=True)
class Matching:
    """``share``: part of a passage a document must hold. ``phrase``: adjacent terms of an exact match.

    A piece goes on across up to ``gap`` words of other matter; up to ``hole`` words of the passage
    beside or between phrases are looked up one by one. Of the letters of the words matched at most ``misread``
    may be others than the passage's, easily confused with them. ``most`` bounds the words of all passages together that are
    sent to the blocks at once; more are done in turns. ``block`` is the number of characters of
    a block of pages.
    """

    share: float = 0.5
    phrase: int = 3
    gap: int = 80
    hole: int = 8
    misread: float = 0.15
    most: int = 500_000
    block: int = 1_000_000


class _Passages:
    """The distinct passages as numbers of terms, and the places of their phrases.

    A phrase has ``phrase`` terms, in passages of few words as many as are half of them. Phrases of
    equal length are kept together, as ``(terms, passage and place of each use)``.
    """

    def __init__(self, items: list[tuple[int, list[str]]], phrase: int):
        by_words: dict[tuple[str, ...], list[int]] = {}
        for item, passage in items:
            if passage:
                by_words.setdefault(tuple(passage), []).append(item)
        self.items = list(by_words.values())
        self.terms: dict[str, int] = {}
        self.ids = [np.array([self.terms.setdefault(alike(t), len(self.terms)) for t in w], np.int64) for w in by_words]
        self.words = list(by_words)
        if len(self.terms) >= 1 << _TERM:
            raise ValueError(f"at most {1 << _TERM} terms at once; lower Matching.most")
        self.lengths = np.array([len(x) for x in self.ids], np.int64)
        self.sizes = np.minimum(phrase, (self.lengths + 1) // 2)
        self.phrases: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(self.sizes).tolist():
            parts = [(np.lib.stride_tricks.sliding_window_view(self.ids[k], size), k) for k in np.flatnonzero(self.sizes == size)]
            every = np.concatenate([p for p, _ in parts])
            passage, place = (np.concatenate(x) for x in ([np.full(len(p), k) for p, k in parts], [np.arange(len(p)) for p, _ in parts]))
            distinct, which = np.unique(every, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            first = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
            self.phrases.append((distinct, first, passage[order], place[order]))


def build_index(documents: DataFrame, doc: str, text: str, block: int = Matching.block) -> DataFrame:
    """The inverted lists of each block of pages, as one row: ``(ids, terms, first, pages, positions)``.

    ``ids`` are the documents of the block by page number. The postings of ``terms[k]`` are entries
    ``first[k]`` to ``first[k + 1]`` of ``pages`` and ``positions``, in order of page, then position. Numbers
    are little-endian bytes of 8, 8, 2 and 4 bytes. Documents whose text is null are left out.
    """

    def row(pages: list[tuple[int | None, str]]) -> pa.RecordBatch:
        numbers: dict[str, int] = {}
        term, count = [], []
        for _, t in pages:
            own = [numbers.setdefault(w, len(numbers)) for w in words(t)]
            term.append(np.array(own, np.int32))
            count.append(len(own))
        flat = np.concatenate(term)
        page = np.repeat(np.arange(len(pages), dtype=np.uint16), count)
        position = np.concatenate([np.arange(n, dtype=np.uint32) for n in count])
        order = np.argsort(flat, kind="stable")
        first = np.searchsorted(flat[order], np.arange(len(numbers) + 1)).astype(np.int64)
        data = [[[i for i, _ in pages]], [list(numbers)], [first.tobytes()], [page[order].tobytes()], [position[order].tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(data, _INDEX)], schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((i, t))
                size += len(t)
                if size >= block or len(held) == 1 << _PAGE:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "ids array<bigint>, terms array<string>, first binary, pages binary, positions binary")


_INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("first", pa.binary()), ("pages", pa.binary()), ("positions", pa.binary())])


class _Block:
    """The lists of a block for the terms of the passages, merged for words that are easily confused.

    ``keys`` are the postings ``(term, page, position)`` in order; ``word`` is the number of the very
    word at each.
    """

    def __init__(self, terms: list[str], first: bytes, pages: bytes, positions: bytes, passages: _Passages):
        numbers = np.array([passages.terms.get(alike(t), -1) for t in terms], np.int64)
        n = np.diff(np.frombuffer(first, np.int64))
        known = np.repeat(numbers >= 0, n)
        keys = (np.repeat(numbers, n)[known] << _PAGE | np.frombuffer(pages, np.uint16)[known]) << _AT | np.frombuffer(positions, np.uint32)[known]
        order = np.argsort(keys, kind="stable")
        self.words, self.keys, self.word = terms, keys[order], np.repeat(np.arange(len(n)), n)[known][order]

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of ``terms`` begin and end."""
        return np.searchsorted(self.keys, terms << (_PAGE + _AT)), np.searchsorted(self.keys, (terms + 1) << (_PAGE + _AT))

    def find(self, terms: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The entries of postings of ``terms`` at ``where``, page and position as one number; -1 where there is none."""
        wanted = terms << (_PAGE + _AT) | where
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[found] == wanted, found, -1)

    def phrases(self, distinct: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of phrases and the places where they begin, by intersection of the lists of their terms.

        The list of each phrase's rarest term, less its offset, is intersected with the next rarer
        ones, less theirs; ``order`` has the offsets by rarity.
        """
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        each = np.arange(len(distinct))
        begin, end = self.lists(distinct[each, order[:, 0]])
        n = end - begin
        # a posting of the rarest term plus this is the posting of another term that the phrase needs
        needed = [(distinct[each, order[:, k]] << (_PAGE + _AT)) + order[:, k] - order[:, 0] for k in range(1, distinct.shape[1])]
        mask = (1 << (_PAGE + _AT)) - 1
        out = []
        for part in np.split(each, np.flatnonzero(np.diff(np.cumsum(n) // _AT_ONCE)) + 1):
            upto = np.cumsum(n[part])
            entry = np.repeat(begin[part] - upto + n[part], n[part]) + np.arange(upto[-1] if len(upto) else 0)
            posting = self.keys[entry] & mask
            which: np.ndarray | None = None
            for base in needed:
                wanted = posting + (np.repeat(base[part], n[part]) if which is None else base[which])
                some = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)] == wanted)
                which = part[np.searchsorted(upto, some, side="right")] if which is None else which[some]
                posting = posting[some]
            if which is None:
                which = np.repeat(part, n[part])
            out.append((which, posting - order[which, 0]))
        which, where = (np.concatenate(x) for x in zip(*out))
        return which, where


def _runs(at: np.ndarray, place: np.ndarray, phrase: int, hole: int) -> list[tuple[int, int, int, int]]:
    """Phrases on one diagonal, close to each other, as ``(start, end, from, to)`` in document and passage."""
    out: list[list[int]] = []
    for d, a in sorted(zip((at - place).tolist(), at.tolist())):
        if out and out[-1][2] == d and a - out[-1][1] <= hole:
            out[-1][1] = a + phrase
        else:
            out.append([a, a + phrase, d])
    return sorted((a, b, a - d, b - d) for a, b, d in out)


def _best_chain(runs: list, gap: int) -> tuple[float, list[int]]:
    """The words and the runs of the piece that holds most: runs that follow each other in document and passage."""
    score, before = [], []
    for k, (a, b, q, r) in enumerate(runs):
        best, link = 0.0, -1
        for j in range(k - 1, -1, -1):
            a2, b2, q2, r2 = runs[j]
            if a - a2 > 2 * gap + r - q and a - b2 > gap:
                break
            over = max(0, b2 - a, r2 - q)
            if q <= q2 or r <= r2 or a <= a2 or a - b2 > gap or over >= min(r - q, r2 - q2):
                continue
            if score[j] - over - 1 > best:
                best, link = score[j] - over - 1, j
        score.append(best + r - q)
        before.append(link)
    if not score:
        return 0.0, []
    k = max(range(len(score)), key=score.__getitem__)
    top, path = score[k], []
    while k >= 0:
        path.append(k)
        k = before[k]
    return top, path[::-1]


def _in_order(lists: list[list[int]]) -> list[int]:
    """The most lists that an ascending series can take one number of each of, in their order."""
    tails: list[int] = []
    at: list[tuple[int, int]] = []  # (list, entry before) by entry
    heads: list[int] = []
    for k, numbers in enumerate(lists):
        for x in reversed(numbers):
            i = bisect_left(tails, x)
            at.append((k, heads[i - 1] if i else -1))
            tails[i : i + 1], heads[i : i + 1] = [x], [len(at) - 1]
    out, entry = [], heads[-1] if heads else -1
    while entry >= 0:
        k, entry = at[entry]
        out.append(k)
    return out[::-1]


class _Held:
    """What one page holds of one passage."""

    def __init__(self, block: _Block, page: int, ids: np.ndarray, words: tuple[str, ...], size: int, m: Matching):
        self.block, self.page, self.ids, self.words, self.size, self.m = block, page << _AT, ids, words, size, m

    def _beside(self, low: int, high: int, first: int, last: int) -> list[int]:
        """Words ``low`` to ``high`` of the passage that stand in order at positions ``first`` to ``last``, looked up in their lists."""
        first = max(first, 0)
        if low >= high or first >= last:
            return []
        terms = self.ids[low:high] << (_PAGE + _AT) | self.page
        begin, end = np.searchsorted(self.block.keys, terms | first), np.searchsorted(self.block.keys, terms + min(last, (1 << _AT) - 1))
        mask = (1 << _AT) - 1
        return [low + k for k in _in_order([(self.block.keys[b:e] & mask).tolist() for b, e in zip(begin, end)])]

    def _piece(self, runs: list, seen: np.ndarray) -> np.ndarray:
        """The words of the passage in a chain of runs and beside them; those in ``seen`` are taken."""
        hole = self.m.hole
        mine = np.zeros(len(self.ids), bool)
        end, to = None, None
        for a, b, q, r in runs:
            mine[q:r] = True
            if end is None:
                extra = self._beside(max(0, q - hole), q, a - 2 * hole, a)
            else:
                extra = self._beside(to, q, end, a) if q - to <= hole else []
            mine[extra] = True
            end, to = b, r
        mine[self._beside(to, min(len(mine), to + hole), end, end + 2 * hole)] = True
        return mine & ~seen

    def _read_right(self, runs: list) -> bool:
        """Whether few enough letters of the words matched are others than the passage's."""
        place = np.concatenate([np.arange(q, r) for _, _, q, r in runs])
        at = np.concatenate([np.arange(a, a + r - q) for a, _, q, r in runs])
        entry = self.block.find(self.ids[place], self.page | at)
        wrong = letters = 0
        for e, k in zip(entry.tolist(), place.tolist()):
            if e >= 0:
                there, here = self.block.words[self.block.word[e]], self.words[k]
                letters += len(here)
                if there != here:
                    # one letter read as two is one mistake
                    wrong += sum(map(str.__ne__, there, here)) if len(there) == len(here) else abs(len(there) - len(here))
        return wrong <= self.m.misread * letters

    def _whole(self, runs: list) -> bool:
        """Whether the passage's very words stand there one after the other."""
        place = np.arange(len(self.ids))
        for a, _, q, r in runs:
            if r - q == len(place):
                entry = self.block.find(self.ids, self.page | (a + place))
                if (entry >= 0).all() and all(self.block.words[self.block.word[e]] == w for e, w in zip(entry, self.words)):
                    return True
        return False

    def pieces(self, at: np.ndarray, place: np.ndarray) -> tuple[float, int, int, bool]:
        """The share held by the two largest pieces, their number, where the larger begins, and whether the passage is there as it is."""
        length = len(self.ids)
        runs = _runs(at, place, self.size, self.m.hole)
        whole = self._whole(runs)
        seen = np.zeros(length, bool)
        found: list[tuple[int, list]] = []
        while runs and len(found) < 2:
            top, path = _best_chain(runs, self.m.gap)
            if top < min(self.size + 2, (length + 1) // 2):
                break
            chain = [runs[k] for k in path]
            seen |= self._piece(chain, seen)
            found.append((chain[0][0], chain))
            used = set(path)
            rest = []
            for k, (a, b, q, r) in enumerate(runs):
                if k not in used:
                    free = np.flatnonzero(~seen[q:r])
                    if len(free) >= self.size:  # what is left of the run beyond the piece
                        rest.append((a + int(free[0]), a + int(free[-1]) + 1, q + int(free[0]), q + int(free[-1]) + 1))
            runs = sorted(rest)
        share = float(seen.mean())
        if share < self.m.share or not self._read_right([run for _, chain in found for run in chain]):
            return 0.0, 0, 0, False
        return share, len(found), found[0][0], whole


_FOUND = "doc bigint, item bigint, held double, pieces bigint, position bigint, whole boolean"


def _search(index: DataFrame, passages: _Passages, frequency: np.ndarray, m: Matching) -> DataFrame:
    """Documents whose pieces hold the share of a passage."""
    orders = [np.argsort(frequency[distinct], axis=1, kind="stable") for distinct, _, _, _ in passages.phrases]

    def candidates(block: _Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Pages and passages that can hold the share, with the positions and places of their phrases."""
        for (distinct, first, passage, place), order in zip(passages.phrases, orders):
            which, where = block.phrases(distinct, order)
            n = first[which + 1] - first[which]
            use = np.repeat(first[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            of, at, q = passage[use], np.repeat(where, n), place[use]
            pair = (at >> _AT) * len(passages.items) + of
            by = np.lexsort((q, pair))
            pair, at, q = pair[by], at[by], q[by]
            if not len(pair):
                continue
            start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            count = np.diff(np.r_[start, len(pair)])
            k = pair[start] % len(passages.items)
            # a phrase cannot hold more than itself and the hole behind it, two pieces not more than three holes besides
            step = np.minimum(np.r_[np.diff(q), 0], distinct.shape[1] + m.hole)
            step[np.r_[start[1:], len(q)] - 1] = distinct.shape[1] + 3 * m.hole
            reach = np.add.reduceat(step, start)
            for i in np.flatnonzero(reach >= m.share * passages.lengths[k]):
                some = slice(start[i], start[i] + count[i])
                yield int(pair[start[i]] // len(passages.items)), int(k[i]), at[some] & ((1 << _AT) - 1), q[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, terms, first, pages, positions = (c[k] for c in batch.columns)
                block = _Block(terms.as_py(), first.as_py(), pages.as_py(), positions.as_py(), passages)
                found: list[tuple] = []
                for page, p, at, place in candidates(block):
                    held, pieces, position, whole = _Held(block, page, passages.ids[p], passages.words[p], int(passages.sizes[p]), m).pieces(at, place)
                    if pieces:
                        found += [(ids[page].as_py(), item, held, pieces, position, whole) for item in passages.items[p]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc", "item", "held", "pieces", "position", "whole"])

    return index.mapInArrow(run, _FOUND)


def _frequencies(index: DataFrame, passages: _Passages) -> np.ndarray:
    """The number of postings of each term of the passages in the whole corpus; bounded by the passages' terms."""
    terms = passages.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(terms), np.int64)
        for batch in batches:
            for words_of, first in zip(batch.column(0), batch.column(1)):
                numbers = np.array([terms.get(alike(t), -1) for t in words_of.as_py()], np.int64)
                known = numbers >= 0
                np.add.at(counts, numbers[known], np.diff(np.frombuffer(first.as_py(), np.int64))[known])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    totals = index.select("terms", "first").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms), np.int64)
    counts[totals.column(0).to_numpy()] = totals.column(1).to_numpy()
    return counts


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, matching: Matching = Matching()) -> DataFrame:
    """Documents that hold at least ``share`` of a passage: ``(doc, item, held, pieces, position, whole)``.

    ``held`` is the share of the passage's words found in their order in one or two pieces,
    ``position`` the word at which the larger piece begins, ``whole`` says that the passage's very words
    stand there as an exact phrase. Items that share a passage are given
    each, and so are copies of a document. Null and empty texts and passages match nothing, a null
    document id stays null; a passage of few words is found by phrases of half its words. Other
    columns are ignored.

    The index of the corpus is made once. The passages are read on the driver in turns of up to
    ``most`` words; each turn is searched in the index. No frequency decides what is found.
    """
    index = materialize(build_index(documents, doc, text, matching.block))
    rows = items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint"), passage)

    def search(turn: list[tuple[int, list[str]]]) -> DataFrame:
        passages = _Passages(turn, matching.phrase)
        return _search(index, passages, _frequencies(index, passages), matching)

    done: list[DataFrame] = []
    held: list[tuple[int, list[str]]] = []
    size = 0
    for row in rows.toLocalIterator():
        own = words(row[1])
        if size and size + len(own) > matching.most:
            done.append(materialize(search(held)))  # written, so that the driver can let go of the passages
            held, size = [], 0
        held.append((row[0], own))
        size += len(own)
    return reduce(DataFrame.unionByName, done, search(held))
