import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators.blocks import hot_keys, hot_places, in_blocks
from tickloom.operators.outliers import Limits, Measure, flag_readings

T0 = datetime(2024, 1, 1, 15)
PRICE, VOLUME = Measure("price", False, 8.0), Measure("volume", True, 5.0)


def walk(n, seed=1, step=0.01):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, step))
        out.append([round(x, 4), int(math.exp(rng.gauss(10, 0.5)))])
    return out


def frame(spark, by_key, extra=()):
    rows = [(k, T0 + timedelta(hours=7 * i), i * 100 + j, *v) for j, (k, values) in enumerate(by_key.items()) for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, *extra], "key string, ts timestamp, row bigint, price double, volume bigint").withColumn("block", F.lit("x"))


def flags(df, limits=Limits()):
    return {k: v for k, v in everything(df, limits).items() if v != "shift"}


def everything(df, limits=Limits()):
    return {(r.row, r.measure): r.kind for r in flag_readings(df, "key", "ts", "row", ["row"], [PRICE, VOLUME], limits).collect()}


def planted():
    a, b, c = walk(200), walk(300, 2), walk(250, 3)
    a[50][0] *= 10  # one reading
    for i in (80, 81, 82):
        a[i][1] *= 300  # three readings
    a[120][0], a[130][1] = -1.0, -5
    for i in range(150, 200):
        a[i][0] *= 0.5  # a split: a lasting change
    for i in range(100, 110):
        b[i][0] = b[99][0]  # stuck from its second reading on
    for i in range(200, 204):
        b[i][0] *= 2  # gone again, but after more than three
    c[10][0] *= 5
    c[12][0] *= 5  # two spikes around a sound reading
    want = {(5000, "price"): "spike", **{(i * 100, "volume"): "spike" for i in (80, 81, 82)}, (12000, "price"): "impossible", (13000, "volume"): "impossible"}
    want |= {(i * 100 + 1, "price"): "stuck" for i in range(100, 110)} | {(i * 100 + 2, "price"): "spike" for i in (10, 12)}
    return {"a": a, "b": b, "c": c}, want


def test_planted_values_are_found(spark):
    by_key, want = planted()
    assert flags(frame(spark, by_key)) == want


def test_level_shifts_are_told_from_spikes(spark):
    by_key, want = planted()
    got = everything(frame(spark, by_key))
    shifts = {k for k, v in got.items() if v == "shift"}
    assert (15000, "price") in shifts and shifts <= {(15000, "price"), (20001, "price"), (20401, "price")}


def test_blocks_change_nothing(spark):
    by_key, want = planted()
    df = frame(spark, by_key)
    whole = everything(df, Limits(size=10**9))
    assert {k: v for k, v in whole.items() if v != "shift"} == want
    for size, margin in ((60, 40), (97, 50), (150, 30)):
        assert everything(df, Limits(size=size, margin=margin)) == whole
    rows = df.select("key", F.unix_micros("ts").alias("ts"))
    assert {r[0] for r in hot_keys(rows, "key", 200).collect()} == {"b", "c"}
    places = hot_places(rows, "key", F.floor(F.col("ts") / 86_400_000_000), 60, 40)
    split = in_blocks(rows, places, "key", F.floor(F.col("ts") / 86_400_000_000))
    assert split.where("own").count() == df.count() and split.select("block").distinct().count() > 3
    assert split.groupBy("key", "block").count().agg(F.max("count")).first()[0] < 200


def test_stuck_runs_reach_over_any_number_of_blocks(spark):
    values = walk(2600, 11)
    for first, n in ((480, 130), (900, 1300), (2590, 10)):  # over one edge, over several whole blocks, up to the end
        for i in range(first, first + n):
            values[i][0] = values[first][0]
    values[1500] = [None, None]  # a null does not end a run
    df = frame(spark, {"a": values})
    whole = everything(df, Limits(size=10**9))
    stuck = {k for k, v in whole.items() if v == "stuck"}
    assert stuck == {(i * 100, "price") for first, n in ((480, 130), (900, 1300), (2590, 10)) for i in range(first + 1, first + n) if i != 1500}
    for size, margin in ((500, 40), (333, 100), (1000, 20)):
        assert everything(df, Limits(size=size, margin=margin)) == whole


def test_a_heavy_tail_of_its_own_raises_the_threshold(spark):
    rng, x, values = random.Random(12), 100.0, []
    for _ in range(3000):  # now and then a reading far off, as this source is used to
        x *= math.exp(rng.gauss(0, 0.001))
        values.append([round(x * math.exp(0.001 * min(12.0, rng.paretovariate(1.0))), 6), int(math.exp(rng.gauss(10, 0.5)))])
    assert len(flags(frame(spark, {"a": values}))) < 3
    values[1000][0] *= 2
    assert flags(frame(spark, {"a": values}))[(100000, "price")] == "spike"


def test_false_values_at_the_start_of_a_series(spark):
    a, b, c = walk(100, 5), walk(100, 6), walk(100, 7)
    a[0][0] *= 10
    for i in range(3):
        b[i][0] /= 10
    for i in range(4):
        c[i][0] *= 10  # too long for a spike
    assert flags(frame(spark, {"a": a, "b": b, "c": c})) == {(0, "price"): "spike", **{(i * 100 + 1, "price"): "spike" for i in range(3)}}


def test_a_null_key_in_blocks_is_judged_by_all_its_rows(spark):
    values = walk(150, 8, 0.001) + walk(250, 9, 0.01)
    for i in (40, 70, 100):
        values[i][0] *= 1.03  # much for its neighbours, not for the whole
    small = Limits(size=60, margin=40)
    assert flags(frame(spark, {None: values}), small) == flags(frame(spark, {"a": values}), small) == {}


def test_rows_of_a_reading_are_judged_each(spark):
    values = walk(100)
    wrong = (T0 + timedelta(hours=7 * 40), 777, values[40][0] * 20, values[40][1])
    got = flags(frame(spark, {"a": values}, [("a", *wrong), ("a", wrong[0], 778, *wrong[2:])]))
    assert got == {(777, "price"): "spike", (778, "price"): "spike"}


def test_a_source_that_hardly_moves(spark):
    values = [[10.0, 7] for _ in range(120)]
    values[60] = [1000.0, 7]
    for i in range(90, 120):
        values[i][0] = 20.0  # a level of its own
    df = frame(spark, {"a": values})
    want = {(6000, "price"): "spike", (9000, "price"): "shift"}
    assert everything(df) == want and everything(df, Limits(size=50, margin=30)) == want
    assert everything(frame(spark, {"a": values[50:65]})) == {}  # too few readings to say


def test_thin_trading_few_rows_nulls_and_empty(spark):
    rng, price, sticky = random.Random(4), 10.0, []
    for _ in range(300):
        if rng.random() < 0.4:
            price *= math.exp(rng.gauss(0, 0.01))
        sticky.append([round(price, 2), 0 if rng.random() < 0.5 else int(math.exp(rng.gauss(5, 0.5)))])
    assert flags(frame(spark, {"a": sticky})) == {}
    few = frame(spark, {"a": [[1.0, 1], [50.0, 1], [0.0, -1], [None, None]]})
    assert flags(few) == {(200, "price"): "impossible", (200, "volume"): "impossible"}
    assert flags(few.limit(0)) == {}
    odd = frame(spark, {None: walk(60), "b": [[None, None]] * 30}, [("c", None, 999, 5.0, 5)])
    assert flags(odd) == {}
    unnamed = frame(spark, {"a": walk(60)}, [("a", None, None, -1.0, 5), ("a", None, None, None, None), (None, None, None, None, -1)])
    assert flags(unnamed) == {(None, "price"): "impossible", (None, "volume"): "impossible"}
