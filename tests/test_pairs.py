"""Joins on an inequality under a count: the same numbers, without a row for each pair."""

import pytest

from assayline.model import Check, Status
from assayline.operators.checks import KINDS, Context
from assayline.operators.pairs import _rewritten, counted, pairs
from assayline.plans.engine import check_frame

NAN = float("nan")


@pytest.fixture(scope="module")
def tables(spark):
    left = [(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0), (2, "a", NAN), (2, "a", 0.0), (2, "a", -0.0), (None, "a", 9.0), (1, None, 5.0), (2, "b", None), (3, "a", 7.0)]
    right = [(1, "a", 1.0), (1, "a", 0.5), (1, "b", 3.0), (2, "a", NAN), (2, "a", -0.0), (2, "b", 0.0), (None, "a", 1.0), (2, None, -5.0), (1, "a", None), (4, "a", 1.0)]
    spark.createDataFrame(left, "k int, t string, x double").createOrReplaceTempView("lefts")
    spark.createDataFrame(right, "k int, t string, x double").createOrReplaceTempView("rights")


def without_pairs(df):
    out = _rewritten(df)
    assert out is not None and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.schema == df.schema
    return out.first()


@pytest.mark.parametrize(
    "condition",
    [
        "a.k = b.k AND a.x > b.x",
        "a.k = b.k AND a.x >= b.x",
        "b.k = a.k AND a.x < b.x",
        "b.k = a.k AND b.x >= a.x",
        "a.k = b.k AND a.t = b.t AND b.x > a.x + 0.5",
        "a.k + 1 = b.k AND a.x * 2 <= b.k",
        "a.k = b.k AND a.t < b.t",
        "a.x >= b.x",
        "b.t <= a.t",
    ],
)
def test_counts_equal_the_join(spark, tables, condition):
    df = spark.sql(f"SELECT count(*) AS n, count(*) = 0 AS none, 7 FROM lefts a JOIN rights b ON {condition}")
    assert without_pairs(df) == df.first()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) = 0 FROM lefts a, rights b WHERE a.k = b.k AND a.x > b.x AND a.t = 'a' AND b.x > 0.6",
        "SELECT count(*) = 0 FROM lefts a JOIN lefts b ON a.k = b.k AND a.x > b.x + 10000",
        "SELECT count(1) FROM lefts a LEFT JOIN rights b ON a.k = b.k WHERE a.x > b.x",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k JOIN rights c ON b.k = c.k AND a.x > c.x",
        "SELECT n = 0 FROM (SELECT count(*) AS n FROM (SELECT k, max(x) AS x FROM lefts GROUP BY k) a JOIN rights b ON a.x > b.x)",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x AND b.k > 99",
    ],
)
def test_other_notations(spark, tables, sql):
    df = spark.sql(sql)
    assert without_pairs(df) == df.first()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k <=> b.k AND a.x > b.x",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x AND a.t < b.t",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k AND a.x - b.x > 1",
        "SELECT count(*) FROM lefts a LEFT JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT count(*) FROM lefts a LEFT SEMI JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT count(b.t) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT count(DISTINCT 1) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT count(*) FILTER (WHERE a.t = 'a') FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT count(*), max(a.x) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x",
        "SELECT a.k, count(*) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x GROUP BY a.k",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k AND a.x > b.x HAVING count(*) > 99",
        "SELECT count(*) FROM lefts a JOIN rights b ON a.k = b.k AND (a.x > b.x OR a.t > b.t)",
    ],
)
def test_other_queries_stay_as_written(spark, tables, sql):
    assert _rewritten(spark.sql(sql)) is None


def test_operands_of_rows_that_meet_none(spark):
    """Here one operand can't be computed, but no pair needs it."""
    spark.createDataFrame([(1, 5)], "k int, x int").createOrReplaceTempView("numbers")
    spark.createDataFrame([(1, "3"), (2, "three")], "k int, x string").createOrReplaceTempView("texts")
    df = spark.sql("SELECT count(*) AS n FROM numbers a JOIN texts b ON a.k = b.k AND a.x > CAST(b.x AS INT)")
    assert counted(df) is df
    assert check_frame(spark.range(1), [{"custom_sql": "SELECT count(*) = 1 FROM numbers a JOIN texts b ON a.k = b.k AND a.x > CAST(b.x AS INT)"}]).results[0].status is Status.PASS


def test_frequent_key_divides(spark):
    """More than one range of one key, and no key."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(60_000).selectExpr("id % 2 * 0 AS k0", "id AS v")
        assert pairs(df, df).first().pairs == 60_000 * 59_999 // 2
        assert pairs(df, df, equal=True).first().pairs == 60_000 * 60_001 // 2
        one = df.select("v")
        assert pairs(one, one.selectExpr("v + 59999 AS v"), equal=True).first().pairs == 1
        assert pairs(one, one.limit(0)).first().pairs == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_custom_sql_makes_no_pairs(spark):
    """The check's own query: 60,000 rows of one key, for which a join compares 3,600 million pairs."""
    spark.range(60_000).selectExpr("1 AS k", "id AS x").createOrReplaceTempView("many")
    sql = "SELECT count(*) = 1 FROM many a JOIN many b ON a.k = b.k AND a.x >= b.x + 59999"
    own = KINDS["custom_sql"].own(None, Check("custom_sql", params={"query": sql}), Context(spark))
    assert "Join" not in own._jdf.queryExecution().optimizedPlan().toString()
    assert own.first().asDict() == {"first": True}
    assert check_frame(spark.range(1), [{"custom_sql": sql}]).results[0].status is Status.PASS
