"""Every registered query of the engine against its SQL in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from assayline import catalog, catalog_verdicts  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    want = sorted(([plain(r[order.index(c)]) for c in names] for r in cursor.fetchall()), key=repr)
    assert got == want


def test_metadata_query(spark):
    found = {(r.table_name, r.column_name): r.category for r in catalog.schema_types(spark, SF).collect()}
    assert found["events", "ts"] == "timestamp" and found["orders", "o_totalprice"] == "float"


def test_entry_points(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == len(catalog.SUITE.checks) and not any(r.status == "error" for r in rows)
