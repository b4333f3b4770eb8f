import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def agrees(spark, duck):
    import pandas as pd

    clean = lambda v: None if v is None or v is pd.NA or v != v else (int(v) if isinstance(v, float) and v.is_integer() else v)

    def check(query, sql):
        got, want = query(spark, SF), duck.sql(sql)
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        at = [want.columns.index(n) for n in names]
        g = sorted(repr([clean(r[n]) for n in names]) for r in got.collect())
        w = sorted(repr([clean(r[i]) for i in at]) for r in want.fetchall())
        assert g == w

    return check
