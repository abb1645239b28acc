"""Each kind of check on small tables with faults; fused and single runs must agree."""

from datetime import datetime
from decimal import Decimal

import pytest

from assayline.functions import scalars
from assayline.model import Check, Status
from assayline.operators.checks import Context
from assayline.plans.config import parse_check
from assayline.plans.engine import check_frame, run_checks
from assayline.plans.planner import plan

AS_OF = datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def faulty(spark):
    rows = [
        (1, "a", "x@example.com", Decimal("10.00"), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 30), "EUR"),
        (2, "b", "bad", Decimal("-5.00"), datetime(2024, 1, 1), datetime(2024, 1, 1, 2), "USD"),
        (2, None, "y@example.com\n", None, None, datetime(2024, 1, 1), "XYZ"),
        (None, "a", None, Decimal("99.00"), datetime(2023, 12, 31), None, None),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id int, name string, email string, amount decimal(10,2), made timestamp_ntz, loaded timestamp_ntz, currency string")


def one(df, raw, **options):
    (result,) = check_frame(df, [raw], as_of=AS_OF, **options).results
    return result


CASES = [
    ("not_null: id", "fail", "2 nulls"),
    ({"completeness": {"column": "id", "min": "60%"}}, "pass", "60.0%"),
    ({"completeness": {"column": "id", "min": 61}}, "fail", "60.0%"),
    ("unique: id", "fail", "1 duplicates"),
    ("unique: name", "fail", "1 duplicates"),
    ({"unique_combination": ["id", "name"]}, "pass", "0 duplicates"),
    ({"accepted_values": {"column": "currency", "values": ["EUR", "USD"]}}, "fail", "1 invalid values"),
    ({"accepted_values": {"column": "id", "values": ["1", "2", "two"]}}, "pass", "0 invalid values"),
    ({"range": {"column": "amount", "min": 0, "max": 50}}, "fail", "min=-5.00, max=99.00"),
    ({"range": {"column": "amount"}}, "pass", "min=-5.00, max=99.00"),
    ({"regex": {"column": "name", "pattern": "^a"}}, "warn", "1 non-matching"),
    ("email_validation: email", "warn", "2 invalid emails"),
    ({"type": {"column": "ID", "expected": "BIGINT"}}, "pass", "int"),
    ({"type": {"column": "made", "expected": "timestamp"}}, "pass", "timestamp_ntz"),
    ({"type": {"column": "name", "expected": "double precision"}}, "fail", "string"),
    ({"type": {"column": "nope", "expected": "int"}}, "error", "column 'nope' not found"),
    ({"freshness": {"column": "made", "max_age": "24h"}}, "pass", "1d 0h ago"),
    ({"freshness": {"column": "made", "max_age": "23h"}}, "fail", "1d 0h ago"),
    ({"latency": {"source_column": "made", "target_column": "loaded", "max_latency": "1h"}}, "warn", "avg=1h 15m, max=2h 0m"),
    ({"row_count": {"min": 6}}, "fail", "5"),
    ({"row_count": {"min": 1, "max": 5}}, "pass", "5"),
    ({"anomaly": {"column": "amount", "metric": "mean"}}, "skip", "34.666667 (no history available)"),
    ({"row_count_change": {}}, "skip", "5 rows (no history available)"),
    ({"accepted_values": {"column": "name", "values": []}}, "error", "error: No accepted values specified"),
    ({"range": {"column": "amount", "min": "low"}}, "error", "error: range min must be a number, not 'low'"),
    ({"custom_sql": " "}, "error", "error: No query provided. Use custom_sql: SELECT ..."),
    ({"anomaly": {"column": "amount"}}, "error", "error: 'metric' parameter is required"),
    ({"nonsense": "id"}, "error", None),
    ("not_null: missing_column", "error", None),
]


@pytest.mark.parametrize("raw,status,observed", CASES, ids=[str(c[0]) for c in CASES])
def test_check(faulty, raw, status, observed):
    result = one(faulty, raw)
    assert str(result.status) == status, result
    if observed is not None:
        assert result.observed.split(" (")[0] == observed.split(" (")[0]


def test_fused_equals_single(faulty):
    checks = [c for c, s, _ in CASES if s != "error"]
    fused, single = (check_frame(faulty, checks, as_of=AS_OF, fuse=f).results for f in (True, False))
    strip = lambda rs: [(r.check, r.status, r.observed, r.expected, r.row_count, r.failing_rows, r.sample) for r in rs]
    assert strip(fused) == strip(single)


def test_a_bad_check_leaves_the_others(faulty):
    results = check_frame(faulty, ["not_null: missing", "not_null: id", {"range": {"column": "amount", "min": "x"}}, "row_count"]).results
    assert [str(r.status) for r in results] == ["error", "fail", "error", "pass"]


def test_equal_metrics_are_computed_once(faulty, spark):
    context = Context(spark)
    context.frame = faulty
    checks = [Check("completeness", "id"), Check("completeness", "id", params={"min": 1}), Check("not_null", "id"), Check("row_count"), Check("unique", "id")]
    made = plan(faulty, checks, context)
    assert len(made.columns) == 3 and made.alone == [4]
    assert made.names[0] == made.names[1]
    results = run_checks(faulty, checks, context)
    assert [r.check for r in results] == checks  # one result for each, equal checks included


def test_several_columns_make_several_checks(faulty):
    assert [r.check.column for r in check_frame(faulty, [{"not_null": ["id", "name"]}]).results] == ["id", "name"]


def test_samples_are_ordered_and_bounded(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS v").repartition(7)
    result = one(df, "not_null: v")
    assert len(result.sample) == 5 and list(result.sample) == sorted(result.sample) and result.failing_rows == 50


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, at timestamp_ntz")
    checks = ["not_null: id", "completeness: id", "unique: id", {"range": {"column": "id", "min": 0}}, "freshness: at", "row_count", {"regex": {"column": "id", "pattern": "1"}}]
    assert [str(r.status) for r in check_frame(empty, checks).results] == ["pass", "fail", "pass", "pass", "fail", "pass", "pass"]


def test_references(spark):
    spark.createDataFrame([(1,), (2,), (None,)], "id int").createOrReplaceTempView("people")
    df = spark.createDataFrame([(1,), (3,), (None,)], "person int")
    raw = {"referential_integrity": {"column": "person", "reference_table": "people", "reference_column": "id"}}
    result = one(df, raw)
    assert result.observed == "1 orphaned rows" and result.row_count == 2 and result.sample == ('{"person":3}',)
    assert one(df, {"referential_integrity": {"column": "person"}}).status is Status.ERROR
    assert one(df, {"referential_integrity": {"column": "person", "reference_table": "nowhere", "reference_column": "id"}}).status is Status.ERROR


def test_custom_sql(spark):
    spark.range(3).createOrReplaceTempView("three")
    df = spark.range(1)
    assert one(df, {"custom_sql": "SELECT count(*) = 3 FROM three"}).status is Status.PASS
    assert one(df, {"custom_sql": {"query": "SELECT count(*) > 3 AS big, 1 FROM three"}}).status is Status.FAIL
    assert one(df, {"custom_sql": "SELECT 1 FROM three WHERE id > 9"}).status is Status.ERROR
    assert one(df, {"custom_sql": "SELECT nonsense FROM three"}).status is Status.ERROR


def test_nan_and_struct_fields(spark):
    df = spark.createDataFrame([(float("nan"), (1,)), (1.0, (None,))], "v double, s struct<a:int>")
    assert one(df, {"range": {"column": "v", "max": 5}}).failing_rows == 1
    assert one(df, "not_null: s.a").observed == "1 nulls"


def test_severity_and_score(faulty):
    result = check_frame(faulty, [{"not_null": {"column": "id", "severity": "info"}}, "row_count", {"not_null": "name", "severity": "blocker"}])
    assert [str(r.status) for r in result.results] == ["warn", "pass", "fail"]
    assert result.quality_score == round(100 * 1.25 / 2.25, 1) and result.status is Status.FAIL
    assert check_frame(faulty, []).quality_score == 100.0


def test_scalars():
    assert [scalars.seconds_of(x) for x in ("30s", "5m", "2h", "7d")] == [30, 300, 7200, 604800]
    assert [scalars.duration_text(x) for x in (59, 61, 3700, 90000)] == ["59s", "1m", "1h 1m", "1d 1h"]
    assert scalars.interval_seconds("1h30m") == 5400 and scalars.interval_text(5400) == "1h30m"
    assert [scalars.fraction_of(x) for x in ("95%", 95, 0.95, "0.5%")] == [0.95, 0.95, 0.95, 0.005]
    for bad in ("1w", "", "h"):
        with pytest.raises(ValueError):
            scalars.seconds_of(bad)
        with pytest.raises(ValueError):
            scalars.interval_seconds(bad if bad != "1w" else "0s")


def test_parse():
    assert parse_check("not_null: a") == Check("not_null", "a")
    assert parse_check({"unique": ["a"]}) == Check("unique", "a")
    assert parse_check({"unique_combination": ["a", "b"]}) == Check("unique_combination", columns=("a", "b"))
    assert parse_check({"severity": "info", "not_null": "a"}) == Check("not_null", "a", severity="info")
    with pytest.raises(ValueError):
        parse_check({})
