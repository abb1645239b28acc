import statistics
from datetime import datetime

import pytest

from assayline.model import ColumnContract, Contract, Sla
from assayline.operators.profile import exact_medians, profile, suggest
from assayline.plans import config as configs
from assayline.plans.contracts import diff, quarantine, validate
from assayline.plans.engine import check_frame

AS_OF = datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(1, "EUR", 5.0, datetime(2024, 1, 1)), (2, "XYZ", -1.0, datetime(2024, 1, 1)), (2, None, 3.0, None)]
    return spark.createDataFrame(rows, "id int, currency string, amount double, made timestamp_ntz")


def contract(**changes):
    columns = (ColumnContract("id", "integer", ("not_null", "unique")), ColumnContract("currency", "varchar", ({"accepted_values": ["EUR", "USD"]},)), ColumnContract("amount", "double precision", ({"range": {"min": 0}},)))
    return Contract(**({"name": "c", "table": "orders", "columns": columns} | changes))


def test_valid(spark, orders):
    good = orders.filter("id = 1")
    found = validate(good, contract(), AS_OF)
    assert found.status == "pass" and [d.change for d in found.drift] == ["added"]


def test_violations(orders):
    found = validate(orders, contract(sla=Sla("12h", "99%", "yes")), AS_OF)
    assert found.status == "warn"
    assert [v.rule for v in found.violations] == ["column.unique", "column.accepted_values", "column.range", "sla.freshness", "sla.completeness"]
    assert validate(orders, contract(on_violation="block"), AS_OF).status == "fail"
    assert validate(orders, contract(on_violation="quarantine"), AS_OF).status == "fail"
    assert validate(orders.limit(0), contract(columns=(), sla=Sla(availability="99.9%"))).violations[0].rule == "sla.availability"
    assert validate(None, Contract("x")).status == "fail"


def test_drift(orders):
    changed = contract(columns=(ColumnContract("ID", "string"), ColumnContract("gone", "int", ("not_null",)), ColumnContract("made", "timestamp")))
    found = validate(orders, changed)
    assert {(d.column, d.change) for d in found.drift} == {("ID", "type_changed"), ("gone", "removed"), ("currency", "added"), ("amount", "added")}
    assert [v.rule for v in found.violations] == ["schema.type_mismatch", "schema.column_missing"]


def test_quarantine(orders):
    good, bad = quarantine(orders, contract())
    assert sorted(r.amount for r in good.collect()) == [3.0, 5.0] and [r.id for r in bad.collect()] == [2]


def test_diff():
    old, new = contract(owner="a"), contract(owner="b", on_violation="block", sla=Sla(freshness="1h"), columns=(ColumnContract("id", "string", ("not_null",)), ColumnContract("new", "int")))
    found = {(c.field, c.change, c.breaking) for c in diff(old, new)}
    assert ("owner", "changed", False) in found and ("on_violation", "changed", True) in found
    assert ("schema.columns.currency", "removed", True) in found and ("schema.columns.new", "added", False) in found
    assert ("schema.columns.id.type", "changed", True) in found and ("schema.columns.id.checks", "removed", False) in found
    assert ("sla.freshness", "added", True) in found
    assert diff(old, old) == []
    # A check in another notation, or another place of the list, is the same check.
    one = contract(columns=(ColumnContract("id", "int", ("not_null", {"range": {"min": 0, "max": 5}})),))
    two = contract(columns=(ColumnContract("id", "int", ({"range": {"max": 5, "min": 0}}, {"not_null": {}})),))
    assert diff(one, two) == []
    dirty = contract(columns=(ColumnContract("id", "int", ("not_null", {"range": {"min": 1, "max": 5}})),))
    assert [(c.field, c.change, c.breaking) for c in diff(one, dirty)] == [("schema.columns.id.checks", "removed", False), ("schema.columns.id.checks", "added", True)]


def test_profile(spark):
    df = spark.createDataFrame([(k, 0.0, "ab" if k % 2 else "c", k % 3 == 0 or None) for k in range(10)], "id long, zero double, s string, b boolean")
    found = profile(df, "t")
    by = {c.name: c for c in found.columns}
    assert found.row_count == 10 and by["id"].distinct_pct == 100 and by["id"].median == 4.5
    assert by["zero"].mean == 0.0 and by["zero"].stddev == 0.0  # zeros are values
    assert by["s"].top_values == [{"value": "ab", "count": 5}, {"value": "c", "count": 5}] and by["s"].mean_length == 1.5
    assert by["b"].null_pct == 60.0
    checks = suggest(found)
    assert {"unique": "id"} in checks and {"row_count": {"min": 5}} in checks
    assert check_frame(df, checks).quality_score == 100.0
    assert len(configs.from_dict(__import__("yaml").safe_load(configs.dump(checks, "spark", "t"))).suites[0].checks) == len(checks)
    for values in ([0.0] * 50 + [1.0] * 50, [0.0] * 50 + [0.5] + [1.0] * 50, [0.0] * 49 + [0.25, 0.5] + [1.0] * 49, [float(k * 7919 % 1000) for k in range(999)], [3.0], [None]):
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        there = [v for v in values if v is not None]
        assert exact_medians(frame, ["v"], few=10)["v"] == (statistics.median(there) if there else None)
    assert 0 < profile(spark.range(1000), sample_percent=50).row_count < 1000
    assert profile(df.limit(0)).columns[0].distinct_pct == 0.0
