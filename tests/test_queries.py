"""Every registered query against its SQL on the smallest tables."""
import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from visorlake.plans.fixtures import TABLES
from visorlake.plans.registry import all_checks, all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = all_queries(), all_checks()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v) + 0.0
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v))
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    if name not in CHECKS:
        assert got[1]
        return
    result = con.execute(CHECKS[name])
    assert got == table([d[0] for d in result.description], result.fetchall())


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES) and len(CHECKS) > 0.75 * len(QUERIES)


@pytest.mark.parametrize("name,table_name", [("t04_stream_gallery", "embeddings"), ("t08_incremental_files", "orders"), ("t08_failure_records", "orders")])
def test_streams_read_tables_in_folders(spark, tmp_path, name, table_name):
    spark.read.parquet(f"{FOLDER}/{table_name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table_name}.parquet")
    got, want = (QUERIES[name](spark, folder) for folder in (str(tmp_path), FOLDER))
    rows = table(got.columns, got.collect())
    assert rows[1] and rows == table(want.columns, want.collect())
