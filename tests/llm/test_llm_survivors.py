import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm.survivors import Quality, consolidate, estimate, judge

D0 = date(2020, 1, 1)


def test_fields_come_from_the_best_row(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 40, 2), 100]), rng.choice([None, 1, 2]), rng.choice([None, "x"]), rng.choice([0, 1])) for i in range(1, 300)]
    df = spark.createDataFrame([(i, k, None if d is None else D0 + timedelta(d), v, w, t, 5) for i, k, d, v, w, t in rows], "id bigint, k string, d date, v int, w string, t int, period int")
    got = {r.first_id: (r.rows, r.v_from, r.w_from) for r in consolidate(df, ["k"], "d", 4, "id", ["v", "w"], [F.col("t")]).collect()}
    want = {}
    for k in "ab":
        chain = sorted(((d, i, v, w, t) for i, kk, d, v, w, t in rows if kk == k and d is not None), key=lambda r: r[:2])
        groups, last = [], None
        for r in chain:
            if last is None or r[0] - last > 4:
                groups.append([])
            groups[-1].append(r)
            last = r[0]
        for g in groups:
            if len(g) > 1:
                pick = lambda f: min(((r[4], r[1]) for r in g if r[f] is not None), default=(0, 0))[1]
                want[min(r[1] for r in g)] = (len(g), pick(2), pick(3))
    assert got == want


def test_ties_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "a", D0, None), (1, "a", D0, None), (2, "b", D0, 5)], "id bigint, k string, d date, v int")
    assert [tuple(r) for r in consolidate(df, ["k"], "d", 4, "id", ["v"], []).select("first_id", "rows", "v_from").collect()] == [(1, 2, 0)]
    assert consolidate(df.limit(0), ["k"], "d", 4, "id", ["v"], []).count() == 0


def test_estimate_finds_the_bad_source():
    rng = np.random.default_rng(1)
    rates = [(0.95, 0.98), (0.9, 0.97), (0.4, 0.5)]
    patterns = {}
    for _ in range(20_000):
        true = rng.random() < 0.5
        yes = no = 0
        for s, (sens, spec) in enumerate(rates):
            if rng.random() < (sens if true else 1 - spec):
                yes |= 1 << s
            else:
                no |= 1 << s
        patterns[yes, no] = patterns.get((yes, no), 0) + 1
    y, m = (np.array([k[i] for k in patterns]) for i in (0, 1))
    rates = estimate(y, m, np.array(list(patterns.values()), float), 3, Quality())
    sens, spec, truth = rates.sens, rates.spec, rates.truth(y, m)
    assert sens == pytest.approx([0.95, 0.9, 0.4], abs=0.03) and spec == pytest.approx([0.98, 0.97, 0.5], abs=0.03)
    assert truth[list(patterns).index((0b011, 0b100))] > 0.9 and truth[list(patterns).index((0b100, 0b011))] < 0.1


def test_judge_keeps_every_true_value(spark):
    rows = []
    for g in range(200):
        rows += [(g, "name", "right", 0), (g, "name", "right", 1), (g, "name", "also", 0), (g, "name", "also", 1), (g, "name", f"wrong{g}", 2), (g, "name", None, 1)]
    df = spark.createDataFrame(rows, "g int, field string, value string, source int").withColumn("yes", F.lit(1))
    judged, rates = judge(df, ["g"], F.col("source"), 3)
    true = {(r.g, r.value) for r in judged.where("truth >= 0.5").collect()}
    assert true == {(g, v) for g in range(200) for v in ("right", "also")}
    assert {r.source: r.sensitivity > 0.5 for r in rates.collect()} == {0: True, 1: True, 2: False}
    with pytest.raises(ValueError):
        judge(df, ["g"], F.col("source"), 63)
    assert judge(df.limit(0), ["g"], F.col("source"), 3)[0].count() == 0


def test_rates_fitted_where_the_patterns_are_and_many_sources(spark):
    rng = random.Random(9)
    rows = []
    for g in range(300):
        for s in rng.sample(range(40), 6):
            good = s % 5 != 0
            rows.append((g, rng.choice(["a", "b"]), "right" if rng.random() < (0.9 if good else 0.2) else f"wrong{rng.randrange(9)}", s))
    df = spark.createDataFrame(rows, "g int, field string, value string, source int")
    results = [judge(df, ["g"], F.col("source"), 40, Quality(local=n, rounds=12)) for n in (10**6, 0)]
    here, there = (sorted(map(tuple, r[1].collect())) for r in results)
    assert [x[:2] for x in here] == [x[:2] for x in there] and np.allclose([x[2:] for x in here], [x[2:] for x in there])
    here, there = ({tuple(x[:3]): x.truth for x in r[0].collect()} for r in results)
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-6 for k in here)
