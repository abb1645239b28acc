"""Registered queries over what users see: verdicts, profiles, contracts, history, windows,
reports and notations, each beside its SQL. Importing this module adds them to ``catalog``.
"""

from __future__ import annotations

import contextlib
import csv
import io
import json
import os
import re
import tempfile
import uuid
from dataclasses import replace
from datetime import datetime

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .catalog import _ADDRESS, _BAD_STATUS, _NULLED, _ORPHANED, AS_OF, SUITE, orders, query, table
from .functions.scalars import TYPE_NAMES, duration_text, fraction_of, interval_seconds, interval_text, seconds_of, type_category
from .model import Alert, Check, CheckResult, ColumnContract, Config, Contract, Sla, Source, Status, Suite, SuiteResult
from .operators import anomaly, profile
from .operators.checks import _BUILT_IN, KINDS, Context, history_key, register, register_plugin
from .orchestrate import QualityError, checked
from .plans import config as configs
from .plans import contracts
from .plans.engine import Engine, check_frame, run_checks
from .plans.planner import expanded
from .sources import convert, outputs
from .sources.resolve import describe, register_connector, resolve
from .sources.store import Store
from .streaming import windows

_COLUMNS = "name string, status string, observed string, row_count long, failing_rows long"


def scratch(spark: SparkSession) -> str:
    """A new folder that the cluster shares, or of this machine on a local master."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='assayline-')}/{uuid.uuid4().hex}"


def verdicts(df: DataFrame, *checks: Check, context: Context | None = None) -> DataFrame:
    """A row for each check that the engine runs over ``df``."""
    context = context or Context(df.sparkSession, as_of=AS_OF)
    results = run_checks(df, list(checks), context, samples=False)
    return df.sparkSession.createDataFrame([(r.check.name, str(r.status), r.observed, r.row_count, r.failing_rows) for r in results], _COLUMNS)


def _rows(*selects: str, over: str) -> str:
    """SQL: one row for each select list over one row of aggregates."""
    return f"WITH x AS ({over}) " + " UNION ALL ".join(f"SELECT {s} FROM x" for s in selects)


def _row(name: str, fails: str, observed: str, rows: str, failing: str, bad: str = "fail") -> str:
    return f"'{name}' AS name, CASE WHEN {fails} THEN '{bad}' ELSE 'pass' END AS status, {observed} AS observed, ({rows})::BIGINT AS row_count, ({failing})::BIGINT AS failing_rows"


def constants(columns: str, rows: list[tuple]) -> str:
    """SQL for fixed rows."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


# --- verdicts of the kinds of checks ------------------------------------------------


@query(
    _rows(
        _row("not_null:cust", "nulls > 0", "nulls || ' nulls'", "n", "nulls"),
        _row("not_null:o_orderkey", "keys < n", "(n - keys) || ' nulls'", "n", "n - keys"),
        _row("completeness:cust", "filled < 0.95 * n", "format('{:.1f}%', 100.0 * filled / n)", "n", "n - filled"),
        _row("completeness:cust", "filled < 0.8 * n", "format('{:.1f}%', 100.0 * filled / n)", "n", "n - filled"),
        _row("row_count", "n < 10", "format('{:,}', n)", "n", "NULL"),
        _row("row_count", "n > 10", "format('{:,}', n)", "n", "NULL"),
        over=f"SELECT count(*) AS n, count(o_orderkey) AS keys, count({_NULLED}) AS filled, count(*) - count({_NULLED}) AS nulls FROM orders",
    )
)
def verdict_completeness(spark, sf_dir):
    return verdicts(
        orders(spark, sf_dir),
        Check("not_null", columns=("cust", "o_orderkey")), Check("completeness", "cust", params={"min": "95%"}), Check("completeness", "cust", params={"min": 80}),
        Check("row_count", params={"min": 10}), Check("row_count", params={"max": 10}),
    )


@query(
    _rows(
        _row("unique:o_orderkey", "n > keys", "(n - keys) || ' duplicates'", "n", "n - keys"),
        _row("unique:cust", "filled > custs", "(filled - custs) || ' duplicates'", "filled", "filled - custs"),
        _row("unique_combination:cust, status", "filled > pairs", "(filled - pairs) || ' duplicates'", "filled", "filled - pairs", "warn"),
        over=f"SELECT count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS keys, count({_NULLED}) AS filled, count(DISTINCT {_NULLED}) AS custs, "
        f"count(DISTINCT CASE WHEN {_NULLED} IS NOT NULL THEN ({_NULLED})::VARCHAR || ':' || {_BAD_STATUS} END) AS pairs FROM orders",
    )
)
def verdict_unique(spark, sf_dir):
    return verdicts(orders(spark, sf_dir), Check("unique", "o_orderkey"), Check("unique", "cust"), Check("unique_combination", columns=("cust", "status"), severity="warning"))


_TYPED = "SELECT *, l_linenumber % 2 = 0 AS even, CAST(l_shipdate AS DATE) AS day FROM lineitem"


@query(
    _rows(
        _row("accepted_values:l_returnflag", "flags > 0", "flags || ' invalid values'", "n", "flags"),
        _row("accepted_values:l_linenumber", "numbers > 0", "numbers || ' invalid values'", "n", "numbers"),
        _row("accepted_values:l_quantity", "quantities > 0", "quantities || ' invalid values'", "n", "quantities"),
        _row("accepted_values:even", "false", "'0 invalid values'", "n", "0"),
        _row("accepted_values:day", "days > 0", "days || ' invalid values'", "n", "days", "warn"),
        _row("accepted_values:l_returnflag", "true", "n || ' invalid values'", "n", "n"),
        over="SELECT count(*) AS n, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS flags, count(*) FILTER (l_linenumber NOT IN (1, 2)) AS numbers, "
        f"count(*) FILTER (l_quantity NOT IN (1, 2.0)) AS quantities, count(*) FILTER (day <> DATE '1995-03-05') AS days FROM ({_TYPED})",
    )
)
def verdict_accepted(spark, sf_dir):
    """Listed values are read with the column's type: text, whole numbers, floats, booleans, days."""
    df = table(spark, sf_dir, "lineitem").withColumn("even", F.col("l_linenumber") % 2 == 0).withColumn("day", F.to_date("l_shipdate"))
    listed = lambda c, v, s=None: Check("accepted_values", c, params={"values": v}, severity=s)
    return verdicts(df, listed("l_returnflag", ["A", "N", "R"]), listed("l_linenumber", ["1", 2]), listed("l_quantity", [1, "2.0"]), listed("even", [True, False]), listed("day", ["1995-03-05"], "info"), listed("l_returnflag", ["O'Neill", "x\\"]))


@query(
    _rows(
        _row("range:c_acctbal", "outside > 0", "'min=' || low || ', max=' || high", "n", "outside"),
        _row("range:c_custkey", "false", "'min=' || first || ', max=' || last", "n", "0"),
        _row("regex:c_name", "odd > 0", "odd || ' non-matching'", "n", "odd", "warn"),
        _row("email_validation:address", "bad > 0", "bad || ' invalid emails'", "n", "bad", "warn"),
        over=f"SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS outside, min(c_acctbal) AS low, max(c_acctbal) AS high, min(c_custkey) AS first, max(c_custkey) AS last, "
        f"count(*) FILTER (NOT regexp_matches(c_name, '[02468]$')) AS odd, count(*) FILTER (c_custkey % 5 = 0 OR c_custkey % 17 = 0) AS bad FROM (SELECT *, {_ADDRESS} AS address FROM customer)",
    )
)
def verdict_values(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("address", F.expr(_ADDRESS))
    return verdicts(df, Check("range", "c_acctbal", params={"min": 0}), Check("range", "c_custkey", params={"min": 0, "max": 10**9}), Check("regex", "c_name", params={"pattern": "[02468]$"}), Check("email_validation", "address"))


_EXPECTED_TYPES = (("o_orderkey", "integer", "pass"), ("o_orderkey", "varchar", "fail"), ("o_totalprice", "double precision", "pass"), ("o_totalprice", "decimal(10,2)", "pass"), ("o_orderdate", "timestamp", "pass"), ("o_orderdate", "date", "fail"), ("o_orderstatus", "VARCHAR(20)", "pass"), ("gone", "integer", "error"))


@query(constants("column_name, expected, status", list(_EXPECTED_TYPES)))
def verdict_type(spark, sf_dir):
    results = run_checks(orders(spark, sf_dir), [Check("type", c, params={"expected": t}) for c, t, _ in _EXPECTED_TYPES], Context(spark))
    return spark.createDataFrame([(r.check.column, r.expected, str(r.status)) for r in results], "column_name string, expected string, status string")


_AGE_TEXT = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 86400 || 'd ' || s % 86400 // 3600 || 'h' END"


@query(
    f"WITH ages AS (SELECT limits, max_age, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(newest::TIMESTAMP)) // 1000000 AS s FROM (SELECT max(ts) AS newest FROM events), (VALUES (3600, '1h'), (86400000, '1000d')) AS l(limits, max_age)), "
    "lags AS (SELECT avg(s)::BIGINT AS mean_s, max(s)::BIGINT AS s, count(*) AS n FROM (SELECT floor(epoch(l_shipdate) - epoch(o_orderdate)) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) "
    f"SELECT 'freshness:ts' AS name, CASE WHEN s <= limits THEN 'pass' ELSE 'fail' END AS status, {_AGE_TEXT} || ' ago' AS observed, NULL::BIGINT AS row_count FROM ages "
    f"UNION ALL SELECT 'latency', CASE WHEN s <= 86400 THEN 'pass' ELSE 'warn' END, 'max=' || {_AGE_TEXT}, n FROM lags"
)
def verdict_freshness(spark, sf_dir):
    """Ages and lags as the checks write them; of a lag the largest, as means of floats differ in their last place."""
    aged = verdicts(table(spark, sf_dir, "events"), Check("freshness", "ts", params={"max_age": "1h"}), Check("freshness", "ts", params={"max_age": "1000d"}))
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lagged = verdicts(df, Check("latency", params={"source_column": "o_orderdate", "target_column": "l_shipdate", "max_latency": "24h"}))
    return aged.unionByName(lagged.withColumn("observed", F.regexp_extract("observed", "max=.*", 0))).drop("failing_rows")


@query(
    f"WITH x AS (SELECT count(c) AS n, count(*) FILTER (c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = c)) AS bad FROM (SELECT {_ORPHANED} AS c FROM orders)), "
    "y AS (SELECT count(*) AS n FROM orders) "
    f"SELECT {_row('referential_integrity:orphaned', 'bad > 0', "bad || ' orphaned rows'", 'n', 'bad')} FROM x "
    f"UNION ALL SELECT {_row('referential_integrity:o_custkey', 'false', "'0 orphaned rows'", 'n', '0')} FROM y"
)
def verdict_reference(spark, sf_dir):
    df = orders(spark, sf_dir).withColumn("orphaned", F.expr(_ORPHANED))
    against = {"reference_table": "customer", "reference_column": "c_custkey"}
    return verdicts(df, Check("referential_integrity", "orphaned", params=against), Check("referential_integrity", "o_custkey", params=against), context=Context(spark, resolve=lambda n: table(spark, sf_dir, n)))


_QUERIES = (
    "SELECT count(*) > 0 FROM {o} JOIN {c} ON o_custkey = c_custkey",
    "SELECT count(*) = 0 FROM {o} LEFT JOIN {c} ON o_custkey = c_custkey WHERE c_custkey IS NULL",
    "SELECT count(*) = 0 FROM {c} FULL OUTER JOIN {o} ON o_custkey = c_custkey WHERE o_orderkey IS NULL",
    "SELECT count(*) = 0 FROM {c} a JOIN {c} b ON a.c_nationkey = b.c_nationkey AND a.c_acctbal > b.c_acctbal + 10000",
    "SELECT max(upper(substr(c_name, 1, 1))) = 'C' AND min(abs(c_acctbal)) >= 0 FROM {c}",
    "SELECT c_custkey FROM {c} WHERE c_custkey < 0",
)


@query(" UNION ALL ".join(f"SELECT {k} AS place, {f"CASE WHEN ({q.format(o='orders', c='customer')}) THEN 'pass' ELSE 'fail' END" if k < 5 else "'error'"} AS status" for k, q in enumerate(_QUERIES)))
def verdict_custom_sql(spark, sf_dir):
    """Inner, outer and inequality joins, functions, and a query without a row."""
    names = {"o": "assayline_orders", "c": "assayline_customer"}
    table(spark, sf_dir, "orders").createOrReplaceTempView(names["o"])
    table(spark, sf_dir, "customer").createOrReplaceTempView(names["c"])
    results = run_checks(spark.range(1), [Check("custom_sql", params={"query": q.format(**names)}) for q in _QUERIES], Context(spark))
    return spark.createDataFrame([(k, str(r.status)) for k, r in enumerate(results)], "place int, status string")


@query(
    "SELECT * FROM (VALUES ('nope:a', 'error'), ('not_null:gone', 'error'), ('range:o_orderkey', 'error'), ('accepted_values:o_orderkey', 'error'), ('regex:o_orderstatus', 'error'), ('latency', 'error'), "
    "('referential_integrity:o_custkey', 'error'), ('anomaly', 'error'), ('custom_sql', 'error'), ('not_null:o_orderkey', 'pass')) AS t(name, status)"
)
def verdict_errors(spark, sf_dir):
    """A check that can't be run is an error of its own, and leaves the rest."""
    checks = [
        Check("nope", "a"), Check("not_null", "gone"), Check("range", "o_orderkey", params={"min": "five"}), Check("accepted_values", "o_orderkey"), Check("regex", "o_orderstatus"), Check("latency"),
        Check("referential_integrity", "o_custkey"), Check("anomaly"), Check("custom_sql"), Check("not_null", "o_orderkey"),
    ]
    return verdicts(table(spark, sf_dir, "orders"), *checks).select("name", "status")


@query(
    f"WITH x AS (SELECT count(*) AS n, count(*) FILTER ({_NULLED} IS NULL) AS nulls, count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS bad, min(o_orderkey) AS low FROM orders) "
    "SELECT 'not_null:a ''quoted\" name' AS name, 'fail' AS status, nulls AS failing_rows FROM x UNION ALL SELECT 'accepted_values:sel`ect', 'fail', bad FROM x UNION ALL SELECT 'not_null:ns.inner', 'pass', 0 FROM x"
)
def odd_names(spark, sf_dir):
    """Columns whose names need quoting, and fields of a struct."""
    df = orders(spark, sf_dir).select(F.col("cust").alias("a 'quoted\" name"), F.col("status").alias("sel`ect"), F.struct(F.col("o_orderkey").alias("inner")).alias("ns"))
    return verdicts(df, Check("not_null", "a 'quoted\" name"), Check("accepted_values", "sel`ect", params={"values": ["F", "O", "P"]}), Check("not_null", "ns.inner")).select("name", "status", "failing_rows")


@query(
    _rows(
        "'not_null:cust' AS check_name, CASE WHEN nulls > 0 THEN 'fail' ELSE 'pass' END AS status, 'critical' AS severity, nulls AS failing_rows",
        "'not_null:o_orderkey', 'pass', 'critical', 0", "'completeness:cust', CASE WHEN n - nulls < 0.95 * n THEN 'fail' ELSE 'pass' END, 'critical', nulls",
        "'accepted_values:status', CASE WHEN bad > 0 THEN 'warn' ELSE 'pass' END, 'warning', bad", "'range:o_totalprice', 'pass', 'critical', 0", "'row_count', 'pass', 'critical', NULL",
        "'unique:o_orderkey', 'pass', 'critical', 0", "'freshness:o_orderdate', CASE WHEN old THEN 'warn' ELSE 'pass' END, 'info', NULL",
        over=f"SELECT count(*) AS n, count(*) FILTER ({_NULLED} IS NULL) AS nulls, count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS bad, max(o_orderdate) < TIMESTAMP '2024-02-01' - INTERVAL 9000 DAY AS old FROM orders",
    )
)
def suite_statuses(spark, sf_dir):
    """Every check of a suite with its severity, fused and alone alike."""
    fused, alone = (Engine(spark, as_of=AS_OF).run_suite(SUITE, orders(spark, sf_dir), samples=False, fuse=fuse) for fuse in (True, False))
    if [(r.status, r.observed) for r in fused.results] != [(r.status, r.observed) for r in alone.results]:
        raise AssertionError("fused and single verdicts differ")
    return fused.frame(spark).select("check_name", "status", "severity", "failing_rows")


@query("SELECT * FROM (VALUES ('daily', 'a'), ('daily', 'b'), ('nightly', 'b'), ('named', 'a')) AS t(chosen_by, suite)")
def suite_filters(spark, sf_dir):
    """Suites by tag and by name, from a configuration."""
    config = Config(suites=tuple(Suite(n, Source("parquet", sf_dir, "nation"), (Check("row_count"),), tags) for n, tags in (("a", ("daily",)), ("b", ("daily", "nightly")))))
    engine = Engine(spark, config)
    found = [("daily", r.suite) for r in engine.run(tags=["daily"])] + [("nightly", r.suite) for r in engine.run(tags=["nightly"])] + [("named", r.suite) for r in engine.run(suites=["a"])]
    return spark.createDataFrame(found, "chosen_by string, suite string")


# --- history ------------------------------------------------------------------------

_WATCHED = ("row_count", "null_count", "null_rate", "distinct_count", "mean", "min", "max")
_U = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END"
#: SQL: (metric, day, x) for every day, and the past and the last day of each metric.
_SERIES = (
    "WITH days AS (SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS row_count, (count(*) - count(u))::DOUBLE AS null_count, (count(*) - count(u))::DOUBLE / count(*) AS null_rate, count(DISTINCT u)::DOUBLE AS distinct_count, "
    f"avg(value) AS mean, min(value) AS min, max(value) AS max FROM (SELECT *, {_U} AS u FROM events) GROUP BY 1), "
    "series AS (UNPIVOT days ON row_count, null_count, null_rate, distinct_count, mean, min, max INTO NAME metric VALUE x), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS r FROM series), past AS (SELECT metric, x FROM ranked WHERE r BETWEEN 2 AND 31), now AS (SELECT metric, x AS v FROM ranked WHERE r = 1), "
)
_SPREADS = (
    "sides AS (SELECT metric, avg(x) AS mu, stddev_samp(x) AS sd, median(x) AS mid, count(*) AS n FROM past GROUP BY 1), "
    "off AS (SELECT metric, 1.4826::DOUBLE * median(abs(x - mid)) AS spread FROM past JOIN sides USING (metric) GROUP BY 1), "
    "placed AS (SELECT metric, x, n, row_number() OVER (PARTITION BY metric ORDER BY x) AS k FROM past JOIN sides USING (metric)), "
    "fences AS (SELECT metric, any_value(n) AS n, " + ", ".join(
        f"sum(CASE WHEN k = greatest(1, least(({q} * (n + 1)) // 4, n - 1)) THEN x * (4 - ({q} * (n + 1) - 4 * greatest(1, least(({q} * (n + 1)) // 4, n - 1)))) / 4 "
        f"WHEN k = greatest(1, least(({q} * (n + 1)) // 4, n - 1)) + 1 THEN x * ({q} * (n + 1) - 4 * greatest(1, least(({q} * (n + 1)) // 4, n - 1))) / 4 END) AS q{q}" for q in (1, 3)
    ) + " FROM placed GROUP BY 1), "
)


def _daily_metrics(spark, sf_dir) -> list[dict]:
    """A row for each day, in order: the watched metrics, as the checks themselves compute them."""
    events = table(spark, sf_dir, "events").withColumn("u", F.expr(_U)).withColumn("day", F.to_date("ts"))
    aggs = [KINDS["anomaly"].fused(Check("anomaly", "u" if m in ("null_count", "null_rate", "distinct_count") else "value", params={"metric": m}), Context(spark))["value"].alias(m) for m in _WATCHED]
    return [r.asDict() for r in events.groupBy("day").agg(*aggs).orderBy("day").collect()]


def _stored_days(spark, sf_dir) -> tuple[Store, list[Check], DataFrame]:
    """A store with a run for each day but the last, the checks, and the last day's rows."""
    events = table(spark, sf_dir, "events").withColumn("u", F.expr(_U)).withColumn("day", F.to_date("ts"))
    checks = [Check("anomaly", "u" if m in ("null_count", "null_rate", "distinct_count") else "value", params={"metric": m, "method": "zscore"}) for m in _WATCHED] + [Check("row_count_change", params={"max_decrease": "5%", "max_increase": "5%"})]
    runs = []
    *before, last = _daily_metrics(spark, sf_dir)
    for day in before:
        kept = [CheckResult(c, Status.SKIP, metrics={m: day[m]}) for c, m in zip(checks, _WATCHED, strict=False)] + [CheckResult(checks[-1], Status.PASS, metrics={"row_count": day["row_count"]})]
        runs.append(SuiteResult("days", tuple(kept), datetime.combine(day["day"], datetime.min.time())))
    store = Store(spark, scratch(spark))
    store.save_all(runs[:10])
    store.save_all(runs[10:])
    store.compact()
    return store, checks, events.filter(F.col("day") == F.lit(last["day"]))


@query(
    _SERIES + _SPREADS.replace("placed AS", "placed_ AS").split("placed_ AS")[0].rstrip(", ")
    + " SELECT metric, CASE WHEN CASE WHEN sd = 0 THEN v <> mu ELSE abs(v - mu) / sd > 3 END THEN 'warn' ELSE 'pass' END AS status, round(v, 6) AS observed FROM sides JOIN now USING (metric) "
    "UNION ALL SELECT 'row_count_change', CASE WHEN abs(v - x) / x > 0.05 THEN 'warn' ELSE 'pass' END, v FROM now JOIN ranked USING (metric) WHERE metric = 'row_count' AND r = 2"
)
def anomaly_store(spark, sf_dir):
    """All watched metrics and the change of the row count, judged by what earlier runs stored."""
    store, checks, last = _stored_days(spark, sf_dir)
    context = Context(spark, suite="days", history=lambda check, metric, n: store.history("days", check, metric, n))
    found = run_checks(last, checks, context)
    rows = [(r.check.params.get("metric", r.check.type), str(r.status), round(float(next(iter(r.metrics.values()))), 6)) for r in found]
    return spark.createDataFrame(rows, "metric string, status string, observed double")


@query(
    _SERIES.rstrip(", ").replace("past AS (SELECT metric, x FROM ranked WHERE r BETWEEN 2 AND 31)", "past AS (SELECT metric, x, day, r FROM ranked WHERE r > 1)")
    + " SELECT metric, strftime(day, '%Y-%m-%d') AS day, round(x, 6) AS value, r <= 6 AS latest FROM past WHERE metric IN ('mean', 'row_count')"
)
def store_history(spark, sf_dir):
    """A metric's series as stored, and which values the latest five are, newest first."""
    store, *_ = _stored_days(spark, sf_dir)
    out = None
    for metric in ("mean", "row_count"):
        key = history_key(Check("anomaly", "value", params={"metric": metric}))
        latest = store.history("days", *key, 5)
        series = store.series("days", *key)
        marks = [r["recorded_at"] for r in series.orderBy(F.desc("recorded_at")).limit(5).collect()]
        if [r["value"] for r in series.orderBy(F.desc("recorded_at")).limit(5).collect()] != latest:
            raise AssertionError("history and series differ")
        one = series.select(F.lit(metric).alias("metric"), F.date_format("recorded_at", "yyyy-MM-dd").alias("day"), F.round("value", 6).alias("value"), F.col("recorded_at").isin(marks).alias("latest"))
        out = one if out is None else out.unionByName(one)
    return out


def _score(z: str, limit: float) -> str:
    """SQL for a detector's score, rounded as Python rounds: by the number's exact value."""
    return f"format('{{:.4f}}', least({z} / {limit}, 1.0))::DOUBLE"


@query(
    _SERIES + _SPREADS.rstrip(", ")
    + " ".join(
        [
            f"{'' if k == 0 else 'UNION ALL'} SELECT metric, '{m}' AS method, '{s}' AS sensitivity, {t} AS is_anomaly, {score} AS score, format('{{:.4f}}', {low})::DOUBLE AS lower, format('{{:.4f}}', {high})::DOUBLE AS upper FROM now JOIN sides USING (metric) JOIN off USING (metric) JOIN fences USING (metric)"
            for k, (m, s, t, score, low, high) in enumerate(
                row
                for s, limit in (("low", 4.0), ("medium", 3.0), ("high", 2.0))
                for row in (
                    ("zscore", s, f"CASE WHEN sd = 0 THEN v <> mu ELSE abs(v - mu) / sd > {limit} END", f"CASE WHEN sd = 0 THEN (v <> mu)::INT ELSE {_score('(abs(v - mu) / sd)', limit)} END", f"mu - {limit} * sd", f"mu + {limit} * sd"),
                    ("mad", s, f"CASE WHEN spread = 0 THEN v <> mid ELSE abs(v - mid) / spread > {limit} END", f"CASE WHEN spread = 0 THEN (v <> mid)::INT ELSE {_score('(abs(v - mid) / spread)', limit)} END", f"mid - {limit} * spread", f"mid + {limit} * spread"),
                    ("iqr", s, f"v < q1 - {limit} * (q3 - q1) OR v > q3 + {limit} * (q3 - q1)",
                     f"CASE WHEN q3 = q1 THEN (v < q1 OR v > q3)::INT ELSE {_score(f'(greatest(q1 - {limit} * (q3 - q1) - v, v - q3 - {limit} * (q3 - q1), 0) / (q3 - q1))', limit)} END", f"q1 - {limit} * (q3 - q1)", f"q3 + {limit} * (q3 - q1)"),
                )
            )
        ]
    )
)
def detector_scores(spark, sf_dir):
    """Every detector at every sensitivity: whether the last day is odd, its score and bounds."""
    *before, last = _daily_metrics(spark, sf_dir)
    rows = []
    for metric in _WATCHED:
        past = [d[metric] for d in before][::-1][:30]
        for method in ("zscore", "mad", "iqr"):
            for sensitivity in anomaly.SENSITIVITY:
                a = anomaly.detect(method, past, last[metric], sensitivity)
                rows.append((metric, method, sensitivity, a.is_anomaly, float(a.score), float(a.lower), float(a.upper)))
    return spark.createDataFrame(rows, "metric string, method string, sensitivity string, is_anomaly boolean, score double, lower double, upper double")


@query(
    "SELECT * FROM (VALUES ('four points', false), ('unknown method', false), ('unknown method, threshold', true), ('threshold over sensitivity', false), ('constant, same', false), ('constant, other', true), "
    "('no history', NULL), ('short history', NULL)) AS t(\"case\", is_anomaly)"
)
def detector_guards(spark, sf_dir):
    """Short histories, unknown names, thresholds and constant histories."""
    past = [10.0, 11.0, 12.0, 11.0, 10.0, 11.0]
    found = [
        ("four points", anomaly.detect("mad", past[:4], 99.0).is_anomaly), ("unknown method", anomaly.detect("none", past, 99.0).is_anomaly),
        ("unknown method, threshold", anomaly.detect("none", past, 99.0, threshold=3).is_anomaly), ("threshold over sensitivity", anomaly.detect("zscore", past, 13.0, "high", threshold=50).is_anomaly),
        ("constant, same", anomaly.detect("mad", [5.0] * 6, 5.0).is_anomaly), ("constant, other", anomaly.detect("iqr", [5.0] * 6, 6.0).is_anomaly),
    ]
    for name, values in (("no history", []), ("short history", [1.0, 2.0])):
        context = Context(spark, history=lambda *_, values=values: values)
        (r,) = run_checks(spark.range(3), [Check("anomaly", params={"metric": "row_count"})], context)
        found.append((name, None if r.status is Status.SKIP else True))
    return spark.createDataFrame(found, "case string, is_anomaly boolean")


@query(
    "SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN previous IS NULL OR previous = 0 THEN 'pass' WHEN (total - previous) / previous::DOUBLE < -0.05 OR (total - previous) / previous::DOUBLE > 0.05 THEN 'warn' ELSE 'pass' END AS status, "
    "format('{:,}', total) || CASE WHEN previous IS NULL THEN ' rows (first run)' ELSE format(' rows ({:+.1f}% from {:,})', 100 * (total - previous) / previous::DOUBLE, previous) END AS observed "
    "FROM (SELECT day, total, lag(total) OVER (ORDER BY day) AS previous FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM events GROUP BY 1))"
)
def row_count_change_verdicts(spark, sf_dir):
    """The check's verdict for each day, with the day before as its history."""
    check, out, past = Check("row_count_change", params={"max_decrease": "5%", "max_increase": "5%"}), [], []
    for day in _daily_metrics(spark, sf_dir):
        kind = KINDS["row_count_change"]
        v = kind.verdict(check, {"rows": int(day["row_count"])}, Context(spark, history=lambda *_, past=past[-1:]: past))
        out.append((str(day["day"]), str(CheckResult(check, v.status, kind.severity).downgraded().status), v.observed))
        past.append(day["row_count"])
    return spark.createDataFrame(out, "day string, status string, observed string")


# --- profiles -----------------------------------------------------------------------


def _profile_sql(t: str, name: str, kind: str, numeric: bool) -> str:
    c = f'"{name}"'
    shape = f"min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median" if numeric else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev, NULL::DOUBLE AS median"
    length = f"min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 4) AS mean_length" if kind == "string" else "NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, NULL::DOUBLE AS mean_length"
    commonest = f"(SELECT string_agg(v || '=' || n, ';' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT (SELECT CASE WHEN count(DISTINCT {c}) <= 20 THEN 20 WHEN count(DISTINCT {c}) <= 50 THEN 10 ELSE 0 END FROM {t})))"
    return f"SELECT '{name}' AS name, '{kind}' AS type, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct, count(DISTINCT {c}) AS distinct_values, round(100.0 * count(DISTINCT {c}) / count(*), 2)::DOUBLE AS distinct_pct, {shape}, {length}, {commonest} AS commonest FROM {t}"


_CUSTOMER = (("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True), ("c_acctbal", "double", True), ("c_mktsegment", "string", False))


@query(" UNION ALL ".join(_profile_sql("customer", *c) for c in _CUSTOMER))
def profile_table(spark, sf_dir):
    """The whole profile of a table, a row for each column."""
    found = profile.profile(table(spark, sf_dir, "customer"), "customer")
    number = lambda x: None if x is None else float(x)
    rows = [
        (c.name, c.type, c.nulls, float(c.null_pct), c.distinct, float(c.distinct_pct), number(c.min), number(c.max), c.mean, c.stddev, c.median, c.min_length, c.max_length, c.mean_length,
         ";".join(f"{v['value']}={v['count']}" for v in c.top_values) or None)
        for c in found.columns
    ]
    kinds = "name string, type string, nulls long, null_pct double, distinct_values long, distinct_pct double, low double, high double, mean double, stddev double, median double, min_length long, max_length long, mean_length double, commonest string"
    return spark.createDataFrame(rows, kinds)


@query(
    "WITH x AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, count(DISTINCT c_name) AS names, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_acctbal) AS sums, count(DISTINCT c_mktsegment) AS segments, "
    "min(c_custkey) AS k0, max(c_custkey) AS k1, min(c_nationkey) AS n0, max(c_nationkey) AS n1, min(c_acctbal) AS a0, max(c_acctbal) AS a1 FROM customer) "
    "SELECT 'not_null' AS kind, c AS on_column, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS t(c) "
    "UNION ALL SELECT 'unique', c, NULL, NULL FROM x, LATERAL (VALUES ('c_custkey', keys), ('c_name', names), ('c_nationkey', nations), ('c_acctbal', sums), ('c_mktsegment', segments)) AS v(c, d) WHERE round(100.0 * d / n, 2) = 100 "
    "UNION ALL SELECT 'row_count', '', greatest(1, n // 2), NULL FROM x "
    + "".join(f"UNION ALL SELECT 'range', '{c}', round({a} - 0.1 * ({b} - {a}), 2), round({b} + 0.1 * ({b} - {a}), 2) FROM x " for c, a, b in (("c_custkey", "k0", "k1"), ("c_nationkey", "n0", "n1"), ("c_acctbal", "a0", "a1")))
    + "UNION ALL SELECT 'accepted_values', 'c_mktsegment', segments, NULL FROM x WHERE segments <= 20"
)
def profile_suggestions(spark, sf_dir):
    """The checks that a profile suggests; all pass on the table, and its YAML reads back."""
    df = table(spark, sf_dir, "customer")
    made = profile.suggest(profile.profile(df, "customer"))
    again = configs.from_dict(yaml.safe_load(configs.dump(made, "spark", "customer"))).suites[0].checks
    if check_frame(df, list(again)).quality_score != 100.0:
        raise AssertionError("a suggested check fails")
    rows = []
    for check in expanded(tuple(again)):
        low = check.params.get("min", len(check.params["values"]) if "values" in check.params else None)
        high = check.params.get("max")
        rows.append((check.type, check.column or "", None if low is None else float(low), None if high is None else float(high)))
    return spark.createDataFrame(rows, "kind string, on_column string, low double, high double")


# --- contracts ----------------------------------------------------------------------

_CONTRACT = Contract(
    "orders", table="orders", sla=Sla("1d", "99%", "99.9%"), on_violation="block",
    columns=(
        ColumnContract("O_ORDERKEY", "integer", ("not_null", "unique")), ColumnContract("cust", "bigint", ("not_null",)), ColumnContract("status", "integer", ({"accepted_values": ["F", "O", "P"]},)),
        ColumnContract("o_totalprice", "double", ({"range": {"min": 0, "max": 100000}}, "unheard_of")), ColumnContract("gone", "string", ("not_null",)),
    ),
)


@query(
    f"WITH x AS (SELECT count(*) AS n, count(o_orderkey) AS keys, count({_NULLED}) AS custs, count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS bad, count(*) FILTER (o_totalprice < 0 OR o_totalprice > 100000) AS outside, "
    "(epoch(TIMESTAMP '2024-02-01') - epoch(max(o_orderdate)))::BIGINT AS s FROM orders) "
    "SELECT 'schema.column_missing' AS rule, 'critical' AS severity, '' AS observed FROM x UNION ALL SELECT 'schema.type_mismatch', 'critical', '' FROM x UNION ALL "
    "SELECT 'column.not_null', 'critical', (n - custs) || ' nulls' FROM x WHERE custs < n UNION ALL SELECT 'column.accepted_values', 'critical', bad || ' invalid values' FROM x WHERE bad > 0 UNION ALL "
    f"SELECT 'column.range', 'critical', '' FROM x WHERE outside > 0 UNION ALL SELECT 'sla.freshness', 'critical', {_AGE_TEXT} FROM x WHERE s > 86400 UNION ALL "
    "SELECT 'sla.completeness', 'critical', format('{:.1f}%', 100.0 * (3 * n + custs) / (4 * n)) FROM x WHERE 3 * n + custs < 0.99 * 4 * n UNION ALL SELECT 'status', 'fail', '' FROM x"
)
def contract_violations(spark, sf_dir):
    """Violations of schema, column checks and service levels, with what was observed."""
    found = contracts.validate(orders(spark, sf_dir), _CONTRACT, AS_OF)
    shown = re.compile(r"([0-9]+ nulls|[0-9]+ invalid values|[0-9.]+%(?=,)|(?<=Data is )[0-9a-z ]+(?= old))")
    rows = [(v.rule, v.severity, m[0] if (m := shown.search(v.message)) else "") for v in found.violations]
    return spark.createDataFrame([*rows, ("status", found.status, "")], "rule string, severity string, observed string")


@query(
    constants(
        "column_name, change, expected, actual",
        [("gone", "removed", "string", ""), ("status", "type_changed", "integer", "string"), ("o_custkey", "added", "", "bigint"), ("o_orderstatus", "added", "", "string"), ("o_orderdate", "added", "", "timestamp_ntz"), ("o_orderpriority", "added", "", "string")],
    )
)
def contract_drift(spark, sf_dir):
    found = contracts.schema_drift(orders(spark, sf_dir), _CONTRACT)
    return spark.createDataFrame([(d.column, d.change, d.expected, d.actual) for d in found], "column_name string, change string, expected string, actual string")


@query(f"SELECT {_NULLED} IS NOT NULL AND {_BAD_STATUS} IN ('F', 'O', 'P') AND o_totalprice BETWEEN 0 AND 100000 AS good, count(*) AS total, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def contract_quarantine(spark, sf_dir):
    """The rows that a contract lets through, and those that it sets aside."""
    own = replace(_CONTRACT, columns=_CONTRACT.columns[:4])
    good, bad = contracts.quarantine(orders(spark, sf_dir), own)
    sums = [F.count(F.lit(1)).alias("total"), F.sum("o_orderkey").alias("keys")]
    return good.agg(F.lit(True).alias("good"), *sums).unionByName(bad.agg(F.lit(False).alias("good"), *sums))


@query(
    constants(
        "field, change, breaking",
        [
            ("owner", "changed", False), ("on_violation", "changed", False), ("sla.freshness", "changed", True), ("sla.completeness", "removed", False), ("schema.columns.cust", "removed", True), ("schema.columns.note", "added", False),
            ("schema.columns.status.type", "changed", True), ("schema.columns.status.checks", "added", True), ("schema.columns.gone.checks", "removed", False),
        ],
    )
)
def contract_diff(spark, sf_dir):
    """Two versions; a check in another notation or place is no change."""
    columns = {c.name: c for c in _CONTRACT.columns}
    new = replace(
        _CONTRACT, owner="someone", on_violation="warn", sla=Sla("2d", "", "99.9%"),
        columns=(
            replace(columns["O_ORDERKEY"], checks=({"unique": {}}, {"not_null": {}})), replace(columns["status"], type="string", checks=({"accepted_values": {"values": ["F", "O", "P"]}}, "not_null")), columns["o_totalprice"],
            replace(columns["gone"], checks=()), ColumnContract("note", "string", ("not_null",)),
        ),
    )
    return spark.createDataFrame([(c.field, c.change, c.breaking) for c in contracts.diff(_CONTRACT, new)], "field string, change string, breaking boolean")


# --- windows and messages -----------------------------------------------------------

_WINDOWED = (
    Check("not_null", "v"), Check("completeness", "v", params={"min": 0.9}, severity="warning"), Check("range", "v", params={"max": 50}, severity="info"), Check("accepted_values", "half", params={"values": [0, "0.5"]}),
    Check("accepted_values", "late", params={"values": [True, False]}), Check("accepted_values", "event_type", params={"values": ["click", "view"]}, severity="blocker"), Check("regex", "event_type", params={"pattern": "^[a-z_]+$"}), Check("row_count", params={"min": 300}),
)
_LIVE = "SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v, (event_id % 3) / 2.0::DOUBLE AS half, event_id % 2 = 0 AS late FROM events"


def _live(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("v", F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END"))
    return df.withColumn("half", (F.col("event_id") % 3) / F.lit(2.0)).withColumn("late", F.col("event_id") % 2 == 0)


@query(
    "WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(v) AS filled, count(*) FILTER (v > 50) AS high, count(*) FILTER (half NOT IN (0, 0.5)) AS halves, count(*) FILTER (event_type NOT IN ('click', 'view')) AS kinds, "
    f"count(*) FILTER (NOT regexp_matches(event_type, '^[a-z_]+$')) AS odd FROM ({_LIVE}) GROUP BY 1) "
    "SELECT strftime(window_start, '%Y-%m-%d') AS day, u.* FROM w, LATERAL (VALUES ('not_null:v', CASE WHEN filled < n THEN 'fail' ELSE 'pass' END, n - filled), ('completeness:v', CASE WHEN filled < 0.9 * n THEN 'warn' ELSE 'pass' END, n - filled), "
    "('range:v', CASE WHEN high > 0 THEN 'warn' ELSE 'pass' END, high), ('accepted_values:half', CASE WHEN halves > 0 THEN 'fail' ELSE 'pass' END, halves), ('accepted_values:late', 'pass', 0), "
    "('accepted_values:event_type', CASE WHEN kinds > 0 THEN 'fail' ELSE 'pass' END, kinds), ('regex:event_type', CASE WHEN odd > 0 THEN 'warn' ELSE 'pass' END, odd), ('row_count', CASE WHEN n < 300 THEN 'fail' ELSE 'pass' END, NULL)) AS u(name, status, failing_rows)"
)
def window_verdicts(spark, sf_dir):
    """Every day's verdicts; types and severities count as they do in a batch."""
    df, context = _live(spark, sf_dir), Context(spark, as_of=AS_OF)
    rows = windows.windowed(df, windows.tumbling("ts", "1 day"), windows.check_metrics(df, list(_WINDOWED), context), time="ts", watermark="1 hour").collect()
    found = [(f"{r['window_start']:%Y-%m-%d}", x.check.name, str(x.status), x.failing_rows) for r in rows for x in windows.verdicts(r.asDict(), list(_WINDOWED), context)]
    return spark.createDataFrame(found, "day string, name string, status string, failing_rows long")


@query(
    "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS total FROM events GROUP BY 1), h AS (SELECT total FROM d WHERE day < (SELECT max(day) FROM d)), b AS (SELECT avg(total) AS m, stddev_samp(total) AS s FROM h) "
    "SELECT strftime(day, '%Y-%m-%d') AS day, total < m - 3 * s OR total > m + 3 * s AS is_anomaly FROM d, b"
)
def window_anomalies(spark, sf_dir):
    """Windows against the bounds that a history of the metric sets."""
    days = windows.windowed(table(spark, sf_dir, "events"), windows.tumbling("ts", "1 day"), {"total": F.count(F.lit(1)).cast("double")}).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    last = days.agg(F.max("day")).first()[0]
    return windows.anomalous(days, "total", days.filter(F.col("day") < last).select("total"), "zscore", 3.0).select("day", "is_anomaly")


@query(
    f"SELECT event_id, CASE WHEN v IS NULL AND event_type NOT IN ('click', 'view') THEN 'not_null:v,accepted_values:event_type' WHEN v IS NULL THEN 'not_null:v' WHEN v > 50 AND event_type NOT IN ('click', 'view') THEN 'range:v,accepted_values:event_type' "
    f"WHEN v > 50 THEN 'range:v' WHEN event_type NOT IN ('click', 'view') THEN 'accepted_values:event_type' ELSE '' END AS failed FROM ({_LIVE})"
)
def message_checks(spark, sf_dir):
    """Each row by itself, as a stream's messages are judged."""
    return windows.judged(_live(spark, sf_dir), [_WINDOWED[0], _WINDOWED[2], _WINDOWED[5]]).select("event_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT event_id, event_id % 4 <> 0 AND props IS NOT NULL AS valid FROM events")
def message_schema(spark, sf_dir):
    """JSON messages, every fourth cut short."""
    df = table(spark, sf_dir, "events").withColumn("message", F.expr("CASE WHEN event_id % 4 = 0 THEN '{\"cut' ELSE props END"))
    return windows.messages(df, "message", "k string").select("event_id", "valid")


@query("SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts::TIMESTAMP)) / 1000000.0::DOUBLE AS lag_seconds FROM events")
def message_lag(spark, sf_dir):
    """From event time to a time of processing."""
    return windows.processing_lag(table(spark, sf_dir, "events"), "ts", F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp_ntz")).select("event_id", "lag_seconds")


@query(constants("name", [(n,) for n in windows.BATCH_ONLY]))
def window_rejections(spark, sf_dir):
    """Checks that a window can't answer are rejected when they are planned."""
    out = []
    for kind in windows.BATCH_ONLY:
        try:
            windows.check_metrics(spark.range(1), [Check(kind, "id", params={"metric": "mean"})], Context(spark))
        except ValueError:
            out.append((kind,))
    return spark.createDataFrame(out, "name string")


# --- sources, reports, notations, extensions ----------------------------------------


@query("SELECT k AS kind, n AS total FROM (SELECT count(*) AS n FROM nation), unnest(['folder', 'file function', 'variable', 'view', 'pandas', 'arrow', 'frame', 'connector', 'csv', 'json']) AS t(k)")
def source_kinds(spark, sf_dir):
    """One table through each kind of source that needs no other host."""
    nation = table(spark, sf_dir, "nation")
    nation.createOrReplaceTempView("assayline_nation")
    os.environ["ASSAYLINE_FOLDER"] = sf_dir
    register_connector("assayline_nation", lambda s, source: table(s, source.connection, source.table))
    folder = scratch(spark)
    nation.write.option("header", "true").csv(f"{folder}.csv")
    nation.write.json(f"{folder}.json")
    frame = nation.toPandas()
    sources = {
        "folder": Source("parquet", sf_dir, "nation"), "file function": Source(table=f"read_parquet('{sf_dir}/nation.parquet')"), "variable": Source("parquet", "${ASSAYLINE_FOLDER}", "nation"), "view": Source(table="assayline_nation"),
        "pandas": frame, "arrow": nation.toArrow(), "frame": nation, "connector": Source("assayline_nation", sf_dir, "nation"), "csv": Source(table=f"read_csv('{folder}.csv')"), "json": Source(table=f"read_json_auto('{folder}.json')"),
    }
    return spark.createDataFrame([(k, resolve(spark, s).count()) for k, s in sources.items()], "kind string, total long")


@query(constants("column_name, type", [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")]))
def source_schema(spark, sf_dir):
    return spark.createDataFrame([(c["name"], c["type"]) for c in describe(table(spark, sf_dir, "events"))], "column_name string, type string")


_REPORTED = (("not_null:cust", "fail"), ("row_count", "pass"), ("regex:status", "warn"), ("nope:x", "error"))


@query(f"SELECT r.format, t.* FROM unnest(['json', 'csv', 'html', 'table', 'store']) AS r(format), ({constants('name, status', list(_REPORTED))}) AS t")
def report_formats(spark, sf_dir):
    """The same results read back out of every form of report."""
    checks = [Check("not_null", "cust"), Check("row_count"), Check("regex", "status", params={"pattern": "^[FO]$"}), Check("nope", "x")]
    result = check_frame(orders(spark, sf_dir), checks, "orders", AS_OF)
    rows = [("json", c["check_name"], c["status"]) for c in json.loads(outputs.as_json([result]))[0]["checks"]]
    rows += [("csv", r["check_name"], r["status"]) for r in csv.DictReader(io.StringIO(outputs.as_csv([result])))]
    rows += [("html", *m) for m in re.findall(r"<tr><td>([^<]*)</td><td class='(\w+)'>", outputs.as_html([result]))]
    rows += [("table", *line.split()[:2]) for line in outputs.as_table(result).split("\n")[2:]]
    store = Store(spark, scratch(spark))
    rows += [("store", r["check_name"], r["status"]) for r in store.details(store.save(result)).collect()]
    return spark.createDataFrame(rows, "format string, name string, status string")


@query(constants("trigger, on_result, fires", [("on_failure", "fail", True), ("on_failure", "pass", False), ("on_success", "fail", False), ("on_success", "pass", True), ("always", "fail", True), ("always", "pass", True), ("unheard_of", "fail", True)]))
def alert_triggers(spark, sf_dir):
    results = {str(r.status): r for r in (check_frame(table(spark, sf_dir, "nation"), [{"row_count": {"min": m}}]) for m in (1, 10**9))}
    cases = [(t, s) for t in ("on_failure", "on_success", "always") for s in ("fail", "pass")] + [("unheard_of", "fail")]
    return spark.createDataFrame([(t, s, outputs.fires(Alert(trigger=t), results[s])) for t, s in cases], "trigger string, on_result string, fires boolean")


_SODA = """
checks for orders:
  - missing_count(o_orderkey) = 0
  - duplicate_count(o_orderkey) < 1
  - missing_percent(o_custkey) <= 20 %
  - row_count between 1 and 100000000
  - max(o_totalprice) <= 10000000
  - invalid_count(o_orderstatus) = 0:
      valid values: [F, O, P]
  - invalid_count(o_orderpriority) = 0:
      valid regex: "^[1-5]-"
  - schema:
      fail:
        when wrong column type: {o_orderkey: bigint}
  - avg(o_totalprice) > 5
"""


@query(
    constants(
        "name, status",
        [("not_null:o_orderkey", "pass"), ("unique:o_orderkey", "pass"), ("completeness:o_custkey", "pass"), ("row_count", "pass"), ("range:o_totalprice", "pass"), ("accepted_values:o_orderstatus", "pass"), ("regex:o_orderpriority", "pass"), ("type:o_orderkey", "pass"), ("# orders: avg(o_totalprice) > 5", "not translated")],
    )
)
def soda_import(spark, sf_dir):
    """A SodaCL file, translated and run."""
    text = convert.from_soda(_SODA)
    found = check_frame(table(spark, sf_dir, "orders"), list(configs.from_dict(yaml.safe_load(text)).suites[0].checks))
    rows = [(r.check.name, str(r.status)) for r in found.results] + [(line, "not translated") for line in text.split("\n") if line.startswith("# orders")]
    return spark.createDataFrame(rows, "name string, status string")


@query(constants("column_name, test", [("cust", "dbt_utils.not_null_proportion"), ("cust", "not_null"), ("o_orderkey", "not_null"), ("o_orderkey", "unique"), ("o_totalprice", "dbt_utils.accepted_range"), ("status", "accepted_values"), ("# orders: freshness:o_orderdate", None), ("# orders: row_count", None)]))
def dbt_export(spark, sf_dir):
    text = convert.to_dbt(Config(suites=(SUITE,)))
    (model,) = yaml.safe_load(text)["models"]
    rows = [(c["name"], t if isinstance(t, str) else next(iter(t))) for c in model["columns"] for t in c["tests"]] + [(line, None) for line in text.split("\n") if line.startswith("# orders")]
    return spark.createDataFrame(rows, "column_name string, test string")


_YAML = """
sources: {folder: {type: parquet, connection: PLACE}}
suites:
  - name: first
    source: folder
    table: customer
    checks: ["not_null: c_custkey", {unique: [c_custkey, c_name]}, {range: {column: c_acctbal, min: 0}, severity: warning}, {completeness: {column: c_name, min: 0.9, severity: info}}]
  - name: second
    source: {type: parquet, connection: PLACE, table: region}
    checks: [{row_count: {min: 1, max: 3}}, {custom_sql: "SELECT 1 = 1"}]
"""


@query(
    "SELECT * FROM (SELECT 'first' AS suite, unnest(['not_null:c_custkey', 'unique:c_custkey', 'unique:c_name', 'completeness:c_name']) AS name, 'pass' AS status) UNION ALL "
    "SELECT 'first', 'range:c_acctbal', CASE WHEN min(c_acctbal) < 0 THEN 'warn' ELSE 'pass' END FROM customer UNION ALL SELECT 'second', 'row_count', CASE WHEN count(*) > 3 THEN 'fail' ELSE 'pass' END FROM region UNION ALL SELECT 'second', 'custom_sql', 'pass'"
)
def config_run(spark, sf_dir):
    """A configuration from YAML, compiled and run; every notation of a check."""
    config = configs.from_dict(yaml.safe_load(_YAML.replace("PLACE", sf_dir)))
    if configs.problems(config):
        raise AssertionError(configs.problems(config))
    return spark.createDataFrame([(s.suite, r.check.name, str(r.status)) for s in Engine(spark, config).run() for r in s.results], "suite string, name string, status string")


@query("SELECT 'returned' AS outcome, count(*) AS total, '' AS reason FROM nation UNION ALL SELECT 'raised', 0, 'nations: row_count ' || count(*) FROM nation")
def workflow_step(spark, sf_dir):
    """A function that makes a frame, with checks on what it returns."""

    def nations():
        return table(spark, sf_dir, "nation")

    rows = [("returned", checked("not_null: n_nationkey", {"row_count": {"min": 1}})(nations)().count(), "")]
    try:
        checked({"row_count": {"max": 2}})(nations)()
    except QualityError as e:
        rows.append(("raised", 0, str(e)))
    return spark.createDataFrame(rows, "outcome string, total long, reason string")


@query("SELECT 'even_rows' AS name, CASE WHEN count(*) % 2 = 0 THEN 'pass' ELSE 'fail' END AS status, (count(*) % 2)::VARCHAR AS observed FROM nation")
def plugin_check(spark, sf_dir):
    """A kind of check that another package adds, fused with the rest."""
    rows = KINDS["row_count"]
    odd = lambda check, v, _: replace(rows.verdict(check, v, _), status=Status.FAIL if v["rows"] % 2 else Status.PASS, observed=str(v["rows"] % 2))
    register(replace(rows, name="even_rows", verdict=odd))
    return verdicts(table(spark, sf_dir, "nation"), Check("even_rows")).select("name", "status", "observed")


_RUN_SQL = (
    "SELECT * FROM (SELECT 'first' AS suite, unnest(['not_null:c_custkey', 'unique:c_custkey', 'unique:c_name', 'completeness:c_name']) AS name, 'pass' AS status) UNION ALL "
    "SELECT 'first', 'range:c_acctbal', CASE WHEN min(c_acctbal) < 0 THEN 'warn' ELSE 'pass' END FROM customer"
)


@query(_RUN_SQL + " UNION ALL SELECT 'exit code', 'run', '0' UNION ALL SELECT 'exit code', 'run of all', CASE WHEN count(*) > 3 THEN '1' ELSE '0' END FROM region UNION ALL SELECT 'exit code', 'validate', '0' UNION ALL SELECT 'history', 'first', 'pass'")
def cli_run(spark, sf_dir):
    """The command line: a run as JSON, its exit codes, and what the store then shows."""
    folder = tempfile.mkdtemp(prefix="assayline-")
    path, store = f"{folder}/checks.yaml", scratch(spark)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_YAML.replace("PLACE", sf_dir))

    def run(*args: str) -> tuple[int, str]:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            code = cli.main([*args], spark)
        return code, out.getvalue()

    code, text = run("run", "-c", path, "--suite", "first", "--format", "json", "--store", store, "--no-alerts")
    rows = [(s["suite"], c["check_name"], c["status"]) for s in json.loads(text) for c in s["checks"]]
    rows += [("exit code", "run", str(code)), ("exit code", "run of all", str(run("run", "-c", path, "--no-alerts", "--no-optimize")[0])), ("exit code", "validate", str(run("validate", "-c", path)[0]))]
    rows += [("history", r["suite_name"], r["status"]) for r in Store(spark, store).runs().collect()]
    return spark.createDataFrame(rows, "suite string, name string, status string")


_SAVED = (Check("not_null", "cust"), Check("completeness", "cust"), Check("row_count"), Check("row_count_change"))


@query(
    _rows(
        "'not_null:cust' AS check_name, 'null_count' AS metric, nulls::DOUBLE AS value", "'not_null:cust', 'fail_rate', nulls / n::DOUBLE", "'completeness:cust', 'completeness_pct', 100 * (n - nulls) / n::DOUBLE", "'row_count', 'row_count', n", "'row_count_change', 'row_count', n",
        over=f"SELECT count(*) AS n, count(*) FILTER ({_NULLED} IS NULL) AS nulls FROM orders",
    )
)
def store_metrics(spark, sf_dir):
    """The metrics that saving a run keeps."""
    store = Store(spark, scratch(spark))
    Engine(spark, store=store).run_suite(Suite("orders", Source(table="orders"), _SAVED), orders(spark, sf_dir), samples=False)
    return store.table("metrics").select("check_name", F.col("metric_name").alias("metric"), "value")


@query(
    _rows(
        "1 AS place, 'orders' AS suite_name, 'fail' AS status, 8 AS total, 8 - (CASE WHEN nulls > 0 THEN 1 ELSE 0 END) - (CASE WHEN n - nulls < 0.95 * n THEN 1 ELSE 0 END) - (CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS passed, "
        "(CASE WHEN nulls > 0 THEN 1 ELSE 0 END) + (CASE WHEN n - nulls < 0.95 * n THEN 1 ELSE 0 END) AS failed, (CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS warned",
        "2, 'orders', 'pass', 1, 1, 0, 0",
        over=f"SELECT count(*) AS n, count(*) FILTER ({_NULLED} IS NULL) AS nulls, count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS bad FROM orders",
    )
)
def store_runs(spark, sf_dir):
    """The runs of a store, latest first, and no more than were asked for."""
    engine = Engine(spark, store=Store(spark, scratch(spark)), as_of=AS_OF)
    for suite in (replace(SUITE, name="older"), replace(SUITE, checks=SUITE.checks[1:2]), SUITE):
        engine.run_suite(suite, orders(spark, sf_dir), samples=False)
    found = engine.store.runs("orders", 2).collect()
    return spark.createDataFrame([(k + 1, r["suite_name"], r["status"], r["total"], r["passed"], r["failed"], r["warned"]) for k, r in enumerate(found)], "place int, suite_name string, status string, total int, passed int, failed int, warned int")


@query(constants("name", [(n,) for n in ("not_null", "completeness", "unique", "unique_combination", "accepted_values", "range", "regex", "email_validation", "type", "freshness", "latency", "row_count", "referential_integrity", "custom_sql", "anomaly", "row_count_change")]))
def check_kinds(spark, sf_dir):
    """The kinds of checks that are built in; a plugin can't take the place of any."""
    out = []
    for name in _BUILT_IN:
        try:
            register_plugin(replace(KINDS["row_count"], name=name))
        except ValueError:
            out.append((name,))
    return spark.createDataFrame(out, "name string")


@query(
    _rows(
        "'not_null:cust' AS name, 'cust' AS on_column, nulls || ' nulls' AS observed, 3 AS total, 1 AS passed, 1 AS failed, 1 AS errored", "'nope:x', 'x', '', 3, 1, 1, 1",
        over=f"SELECT count(*) FILTER ({_NULLED} IS NULL) AS nulls FROM orders",
    )
)
def alert_payload(spark, sf_dir):
    """What a webhook is sent about a run: its counts and the checks that failed."""
    sent = outputs.payload(check_frame(orders(spark, sf_dir), [Check("not_null", "cust"), Check("row_count"), Check("nope", "x")], "orders"))
    rows = [(c["check"], c["column"], "" if c["observed"].startswith("error") else c["observed"], sent["total"], sent["passed"], sent["failed"], sent["errored"]) for c in sent["failed_checks"]]
    return spark.createDataFrame(rows, "name string, on_column string, observed string, total int, passed int, failed int, errored int")


@query(
    constants(
        "place, status, rules",
        [("whole", "pass", ""), ("empty table", "warn", "sla.availability"), ("no timestamp", "warn", "sla.freshness"), ("no table", "warn", "contract.table"), ("blocked", "fail", "schema.column_missing"), ("quarantined", "fail", "column.range")],
    ).replace("('no table', 'warn'", "('no table', 'fail'")
)
def contract_edges(spark, sf_dir):
    """Status and rules of contracts that hold, that meet nothing, and that block."""
    nation = table(spark, sf_dir, "nation")
    base = Contract("nation", table="nation", columns=(ColumnContract("n_nationkey", "integer", ("not_null", "unique", {"range": {"min": 0}})),))
    cases = {
        "whole": (nation, replace(base, sla=Sla(completeness="100%", availability="99%"))), "empty table": (nation.limit(0), replace(base, sla=Sla(availability="99%"))), "no timestamp": (nation, replace(base, sla=Sla(freshness="1d"))),
        "no table": (None, Contract("none")), "blocked": (nation, replace(base, columns=(ColumnContract("gone", "int"),), on_violation="block")),
        "quarantined": (nation, replace(base, columns=(ColumnContract("n_nationkey", "integer", ({"range": {"max": 3}},)),), on_violation="quarantine")),
    }
    found = [(k, contracts.validate(df, c, AS_OF)) for k, (df, c) in cases.items()]
    return spark.createDataFrame([(k, f.status, ",".join(v.rule for v in f.violations)) for k, f in found], "place string, status string, rules string")


@query("SELECT true AS fewer, true AS some, true AS again")
def profile_sample(spark, sf_dir):
    """A profile of a random half of the rows, the same when it is drawn again."""
    df = table(spark, sf_dir, "lineitem")
    one, two = (profile.profile(df, columns=["l_linenumber"], sample_percent=50.0) for _ in range(2))
    return spark.createDataFrame([(one.row_count < df.count(), one.row_count > 0, one.row_count == two.row_count)], "fewer boolean, some boolean, again boolean")


_TEXTS = (("90s", 90), ("15m", 900), ("24h", 86400), ("7d", 604800))


@query(
    "SELECT 'duration' AS form, t AS text, n::DOUBLE AS number, w AS written FROM (VALUES ('90s', 90, '1m'), ('15m', 900, '15m'), ('24h', 86400, '1d 0h'), ('7d', 604800, '7d 0h')) AS a(t, n, w) UNION ALL "
    "SELECT 'interval', t, n, w FROM (VALUES ('1h30m', 5400, '1h30m'), ('45s', 45, '45s'), ('2m5s', 125, '2m5s'), ('3h', 10800, '3h')) AS b(t, n, w) UNION ALL "
    "SELECT 'percent', t, n, NULL FROM (VALUES ('95%', 0.95), ('95', 0.95), ('0.95', 0.95), ('0.5%', 0.005), ('1', 1)) AS c(t, n)"
)
def scalar_notations(spark, sf_dir):
    """Durations, intervals and percentages as numbers, and written again."""
    rows = [("duration", t, float(seconds_of(t)), duration_text(n)) for t, n in _TEXTS]
    rows += [("interval", t, float(interval_seconds(t)), interval_text(interval_seconds(t))) for t in ("1h30m", "45s", "2m5s", "3h")]
    rows += [("percent", t, fraction_of(t), None) for t in ("95%", "95", "0.95", "0.5%", "1")]
    return spark.createDataFrame(rows, "form string, text string, number double, written string")


@query(constants("name, category", [(n, c) for c, names in TYPE_NAMES.items() for n in names] + [("geometry", "geometry"), ("DECIMAL(38,0)", "float")]))
def type_names(spark, sf_dir):
    names = [n for listed in TYPE_NAMES.values() for n in listed] + ["geometry", "DECIMAL(38,0)"]
    return spark.createDataFrame([(n, type_category(n)) for n in names], "name string, category string")
