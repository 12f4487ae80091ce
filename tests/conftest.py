import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from tickloom.session import ship

    ship(session)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def agrees(spark):
    """Whether a query gives the rows of its SQL, on the smallest test tables."""
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no test tables")
    import __spark_entry__

    queries, texts = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duckdb.connect()
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def check(name: str) -> bool:
        df = queries[name](spark, str(SF))
        answer = con.execute(texts[name])
        columns = [d[0] for d in answer.description]
        assert sorted(columns) == sorted(df.columns)
        shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        ours = sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in df.collect())
        places = sorted(range(len(columns)), key=columns.__getitem__)
        return ours == sorted(tuple(shown(r[i]) for i in places) for r in answer.fetchall())

    return check
