"""What the plans of the queries must not and must contain."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_joins_all_with_all(spark, monkeypatch):
    import __spark_entry__

    kind = type(spark.range(1))
    written: list[str] = []
    write = kind.write.fget
    # what a query writes on its way counts as well as what it gives
    monkeypatch.setattr(kind, "write", property(lambda df: (written.append(plan(df)), write(df))[1]))
    for name, query in __spark_entry__.queries().items():
        if not name.startswith("stream_"):
            written.clear()
            for text in (plan(query(spark, SF)), *written):
                assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_what_they_need(spark):
    from tickloom.plans import indicators, readings

    rsi = plan(indicators.QUERIES["rsi"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in rsi
    grid = plan(readings.p5_found(spark, SF))
    assert "PushedFilters: [IsNotNull(symbol)" in grid or "IsNotNull(close)" in grid
    assert "high" not in grid and "volume" not in grid


def test_aggregates_stay_in_the_engine(spark):
    from tickloom.plans import indicators

    for name in indicators.COLUMNS:
        text = plan(indicators.QUERIES[name](spark, SF))
        assert "Python" not in text and "Arrow" not in text, name
