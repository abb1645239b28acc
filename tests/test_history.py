import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayline.model import Check, Config, Source, Status, Suite
from assayline.operators import anomaly
from assayline.operators.checks import WATCHED, Context
from assayline.plans.engine import Engine
from assayline.plans.planner import plan
from assayline.sources.store import Store

PAST = [10.0, 12.0, 11.0, 9.0, 10.5, 11.5]


def test_detectors():
    for method in ("zscore", "mad", "iqr"):
        assert not anomaly.detect(method, PAST, 10.8).is_anomaly
        assert anomaly.detect(method, PAST, 1000.0).is_anomaly
        assert not anomaly.detect(method, PAST[:4], 1000.0).is_anomaly
        assert anomaly.detect(method, [5.0] * 6, 5.1).is_anomaly and not anomaly.detect(method, [5.0] * 6, 5.0).is_anomaly
    z = anomaly.detect("zscore", PAST, 20.0)
    assert z.lower == round(statistics.fmean(PAST) - 3 * statistics.stdev(PAST), 4)
    assert not anomaly.detect("none", PAST, 1000.0).is_anomaly
    assert anomaly.detect("none", PAST, 1000.0, threshold=3).method == "mad"
    assert anomaly.detect("zscore", PAST, 13.5, "high").is_anomaly and not anomaly.detect("zscore", PAST, 13.5, "low").is_anomaly


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=5, max_size=30))
def test_series_bounds_equal_python(spark, values):
    df = spark.createDataFrame([("k", v) for v in values] + [("few", 1.0), ("few", None)], "k string, v double")
    for method, python in anomaly.DETECTORS.items():
        rows = {r.k: r for r in anomaly.series_bounds(df, ["k"], "v", method, 3.0).collect()}
        want = python(values, values[0], 3.0)
        assert rows["few"].lower is None
        assert rows["k"].lower == pytest.approx(want.lower, abs=1e-3, rel=1e-6)
        assert rows["k"].upper == pytest.approx(want.upper, abs=1e-3, rel=1e-6)


def test_history_loop(spark, tmp_path):
    """A check finds what its own earlier runs stored."""
    suite = Suite("s", Source(table="t"), (Check("anomaly", "v", params={"metric": "mean", "method": "zscore"}, severity="critical"), Check("row_count_change"), Check("not_null", "v")))
    engine = Engine(spark, Config(suites=(suite,)), Store(spark, str(tmp_path / "store")))
    frame = lambda n, shift: spark.range(n).selectExpr(f"double(id % 3) + {shift} AS v")
    seen = [engine.run_suite(suite, frame(30 + k, 0.01 * k)) for k in range(6)]
    assert [r.results[0].status for r in seen[:5]] == [Status.SKIP] * 5
    assert seen[0].results[1].observed == "30 rows (first run)"
    assert seen[5].results[0].status is Status.PASS
    last = engine.run_suite(suite, frame(5, 100))
    assert last.results[0].status is Status.FAIL and last.results[1].status is Status.WARN
    assert engine.store.runs("s").count() == 7 and engine.store.runs(limit=3).count() == 3
    run = engine.store.runs("s").first()
    assert run.failed == 1 and engine.store.details(run.run_id).count() == 3
    assert engine.store.series("s", "not_null:v", "null_count").count() == 7
    engine.store.compact()
    assert engine.store.runs("s").count() == 7 and engine.store.series("s", "not_null:v", "null_count").count() == 7
    assert len(list((tmp_path / "store" / "metrics").rglob("*.parquet"))) == 1
    assert Store(spark, str(tmp_path / "empty")).history("s", "x", "y") == []


def test_anomalies_share_one_job(spark):
    """All watched metrics but distinct counts are columns of the one aggregation."""
    checks = [Check("anomaly", "id", params={"metric": m}) for m in WATCHED]
    made = plan(spark.range(5), checks, Context(spark))
    assert len(made.jobs()) == 1 and made.alone == [list(WATCHED).index("distinct_count")] and not made.errors
