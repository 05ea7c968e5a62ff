import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from echofold.runtime import ship_package

    session = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def agree(spark, sf):
    """Compares a query with its SQL on the smallest tables."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")

    def shown(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple(shown(float(x) if hasattr(x, "dtype") and x.dtype.kind in "iuf" or isinstance(x, (int, float)) and not isinstance(x, bool) else x) for x in r) for r in frame.itertuples(index=False))

    def check(query, sql):
        mine, theirs = query(spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows(mine) == rows(theirs)

    return check
