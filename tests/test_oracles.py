"""Every query with an oracle against DuckDB over the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def one(x):
        if x is None or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 9) if isinstance(x, (float, np.floating)) else x

    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).map(one).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_and_table_agree(spark, tmp_path):
    from quillon.streaming.windows import windowed_statistics

    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{SF}/events.parquet*")
    q = windowed_statistics(stream, "ts", "user_id", "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    cols = "user_id", "cast(start as string) as start", "n"
    assert sorted(map(tuple, spark.table("w").selectExpr(*cols).collect())) == sorted(map(tuple, windowed_statistics(table, "ts", "user_id", "value").selectExpr(*cols).collect()))
