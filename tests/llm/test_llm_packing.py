import random
from collections import defaultdict
from pathlib import Path

import pytest

from tickloom.llm.packing import VOCABULARY, pack, plan, tier_of, token_counts


def packed(spark, sizes, capacity=100, tiers=(25, 50), group=4):
    df = spark.createDataFrame([(k, n, 1) for k, n in enumerate(sizes)], "doc bigint, n_tokens bigint, length int")
    return pack(df, capacity, tiers, group, buckets=8).collect()


def check(rows, sizes, capacity=100):
    """Every document whole, nothing overlapping, no window left, offsets without holes in a window."""
    by_doc, by_container = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc].append((r.piece, r.n_tokens))
        if r.container is not None:
            by_container[r.container].append((r.offset, r.n_tokens, r.window))
    for doc, n in enumerate(sizes):
        n = n or 0
        pieces = [x for _, x in sorted(by_doc[doc])]
        assert sum(pieces) == n and len(pieces) == max(1, -(-n // capacity)) and all(x == capacity for x in pieces[:-1])
    for parts in by_container.values():
        ends: dict[int, int] = {}
        [size] = {w for *_, w in parts}  # windows of one size make up a container
        for offset, n, _ in sorted(parts):
            start = offset // size * size
            assert offset == ends.get(start, start)
            ends[start] = offset + n
            assert ends[start] <= start + size <= capacity
    assert sorted(by_container) == list(range(len(by_container)))
    return sum(n for parts in by_container.values() for _, n, _ in parts) / (capacity * max(1, len(by_container)))


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    sizes = [min(700, int(rng.lognormvariate(3.2, 1))) for _ in range(3000)] + [0, None, 100, 200, 101]
    rows = packed(spark, sizes)
    assert check(rows, sizes) > 0.99
    steps = defaultdict(set)
    for r in rows:
        if r.step is not None:
            steps[r.step].add(r.container)
    assert max(map(len, steps.values())) <= 4 and min(map(len, steps.values())) >= 3


def test_tiers_route_pack_and_fill(spark):
    assert [tier_of(n, [25, 50, 100]) for n in (1, 12, 13, 25, 26, 50, 51, 100)] == [25, 25, 50, 50, 100, 100, 100, 100]
    rng = random.Random(7)
    sizes = [min(100, int(rng.lognormvariate(2.7, 0.9)) + 1) for _ in range(4000)]
    plans, rows = {}, {}
    for tiers in ((), (50,), (25, 50)):
        rows[tiers] = packed(spark, sizes, tiers=tiers)
        assert check(rows[tiers], sizes) > 0.99
        plans[tiers] = sorted((r.doc, r.window, r.container, r.offset) for r in rows[tiers])
        of = [*tiers, 100]
        # nothing lies in a window of a shorter tier than its own, and some fill the gaps of longer ones
        assert all(r.window >= tier_of(r.n_tokens, of) for r in rows[tiers])
        assert {r.window for r in rows[tiers]} == set(of)
        assert not tiers or any(r.window > tier_of(r.n_tokens, of) for r in rows[tiers])
    assert len({str(p) for p in plans.values()}) == 3
    tokens = defaultdict(int)
    for r in rows[(25, 50)]:
        tokens[r.step] += r.n_tokens
    full = sorted(tokens.values())
    assert full[-1] - full[0] <= 100  # steps carry like loads, but for one container
    with pytest.raises(ValueError, match="divide"):
        plan({1: 1}, 10, (3,))


def test_one_length_for_most(spark):
    sizes = [40] * 900 + [60] * 300 + [20] * 300
    assert check(packed(spark, sizes), sizes) == pytest.approx(1)


def test_empty_and_edges(spark):
    assert packed(spark, []) == []
    assert [(r.container, r.offset, r.step) for r in packed(spark, [0, None])] == [(None, None, None)] * 2
    assert check(packed(spark, [100]), [100]) == 1
    assert plan({}, 10, (5,)).containers == 0 and plan({10: 3, 1: 10}, 10, (5,)).containers == 4


@pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "the " * 200_000, "x"), (5, "Äpfel <|endoftext|>", "x")], "id bigint, body string, doc string")
    got = {r.doc: r.n_tokens for r in token_counts(df, "id", "body").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 200_000 and got[5] > 4
    assert token_counts(df.limit(0), "id", "body").count() == 0
