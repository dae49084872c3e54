import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


def frame_rows(df):
    """Rows of a pandas frame, columns by name, as comparable text."""
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert frame_rows(got) == frame_rows(want)

    return check
