"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import layerkv.catalog_formats  # noqa: F401
from layerkv import catalog, workloads

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(row):
    return tuple("" if x is None else f"{float(x):.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.SQL[name]})")
    assert sorted(plain(r) for r in df.select(*columns).collect()) == sorted(plain(r) for r in expected.fetchall())


def test_workloads(spark):
    ops = workloads.operations(spark, workloads.SPECS["F"], 2000, 300).cache()
    counts = {r["op"]: r["count"] for r in ops.groupBy("op").count().collect()}
    assert 800 < counts["read"] < 1200 and sum(counts.values()) == 2000
    assert ops.where("key_no = 0").count() > ops.where("key_no = 150").count()
    assert workloads.answers(ops, 300).where("value IS NULL").count() == 0
    latest = workloads.operations(spark, workloads.SPECS["D"], 2000, 300)
    assert latest.where("op = 'read' AND key_no = 299").count() > latest.where("op = 'read' AND key_no = 0").count()
    assert workloads.load(spark, 10).count() == 10
