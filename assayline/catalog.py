"""The registered queries of the engine's own operators, each beside its SQL.

The test tables hold no nulls, orphans or bad addresses, so several queries put faults in,
by the same expression on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.scalars import epoch_seconds
from .model import Check, Source, Suite
from .operators import anomaly, profile
from .operators.checks import EMAIL, KINDS, WATCHED, Context, _duplicated, _orphans, _surplus, quoted
from .plans.contracts import pooled_completeness
from .plans.engine import Engine
from .plans.planner import plan
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = datetime(2024, 2, 1)
_NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END"
_ORPHANED = "CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END"
_BAD_STATUS = "CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("cust", F.expr(_NULLED)).withColumn("status", F.expr(_BAD_STATUS))


def fused(df: DataFrame, check: Check, **names: str) -> DataFrame:
    """A check's fused metrics over a table, renamed; one row."""
    context = Context(df.sparkSession, as_of=AS_OF, frame=df)
    metrics = KINDS[check.type].fused(check, context)
    return df.agg(*[metrics[k].alias(v) for k, v in names.items()])


# --- completeness and uniqueness ----------------------------------------------------


@query(f"SELECT count(*) AS total, count(*) FILTER (c IS NULL) AS nulls FROM (SELECT {_NULLED} AS c FROM orders)")
def not_null_orders(spark, sf_dir):
    return fused(orders(spark, sf_dir), Check("not_null", "cust"), rows="total", nulls="nulls")


@query(f"SELECT count(*) AS total, count(c) AS filled, count(c)::DOUBLE / count(*) AS share, count(c)::DOUBLE / count(*) >= 0.95 AS passes FROM (SELECT {_NULLED} AS c FROM orders)")
def completeness_orders(spark, sf_dir):
    found = fused(orders(spark, sf_dir), Check("completeness", "cust", params={"min": 0.95}), rows="total", filled="filled")
    return found.withColumn("share", F.col("filled") / F.col("total")).withColumn("passes", F.col("share") >= 0.95)


@query("SELECT count(o_orderkey) AS total, count(o_orderkey) - count(DISTINCT o_orderkey) AS surplus FROM orders")
def unique_orders(spark, sf_dir):
    return _surplus(table(spark, sf_dir, "orders"), [quoted("o_orderkey")]).select(F.col("rows").alias("total"), "surplus")


@query(f"SELECT count(c) AS total, count(c) - count(DISTINCT c) AS surplus FROM (SELECT {_NULLED} AS c FROM orders)")
def unique_with_nulls(spark, sf_dir):
    return _surplus(orders(spark, sf_dir), [quoted("cust")]).select(F.col("rows").alias("total"), "surplus")


@query("SELECT count(text) AS total, count(text) - count(DISTINCT text) AS surplus FROM documents")
def unique_text(spark, sf_dir):
    return _surplus(table(spark, sf_dir, "documents"), [quoted("text")]).select(F.col("rows").alias("total"), "surplus")


_COMBINED = "SELECT sum(n)::BIGINT AS total, (sum(n) - count(*))::BIGINT AS surplus FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"


@query(_COMBINED.format(t="lineitem", k="l_orderkey, l_linenumber"))
def unique_combo_lineitem(spark, sf_dir):
    return _surplus(table(spark, sf_dir, "lineitem"), [quoted("l_orderkey"), quoted("l_linenumber")]).select(F.col("rows").alias("total"), "surplus")


@query(_COMBINED.format(t="conversations", k="conv_id, turn"))
def unique_combo_turns(spark, sf_dir):
    return _surplus(table(spark, sf_dir, "conversations"), [quoted("conv_id"), quoted("turn")]).select(F.col("rows").alias("total"), "surplus")


@query("SELECT l_orderkey AS key_0, l_linenumber AS key_1, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return _duplicated(table(spark, sf_dir, "lineitem"), [quoted("l_orderkey"), quoted("l_linenumber")])


# --- validity -----------------------------------------------------------------------


@query(f"SELECT count(c) AS filled, count(*) FILTER (c NOT IN ('F', 'O', 'P')) AS bad FROM (SELECT {_BAD_STATUS} AS c FROM orders)")
def accepted_status(spark, sf_dir):
    return fused(orders(spark, sf_dir), Check("accepted_values", "status", params={"values": ["F", "O", "P"]}), filled="filled", bad="bad")


@query("SELECT count(l_linenumber) AS filled, count(*) FILTER (l_linenumber NOT IN (1, 2, 3)) AS bad FROM lineitem")
def accepted_int(spark, sf_dir):
    return fused(table(spark, sf_dir, "lineitem"), Check("accepted_values", "l_linenumber", params={"values": ["1", "2", "3", "none"]}), filled="filled", bad="bad")


@query("SELECT count(c_acctbal) AS filled, count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) AS bad, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
def range_acctbal(spark, sf_dir):
    return fused(table(spark, sf_dir, "customer"), Check("range", "c_acctbal", params={"min": 0, "max": 9000}), filled="filled", bad="bad", least="least", most="most")


@query("SELECT count(p_brand) AS filled, count(*) FILTER (NOT regexp_matches(p_brand, '^Brand#[1-3][0-9]?$')) AS bad FROM part")
def regex_brand(spark, sf_dir):
    return fused(table(spark, sf_dir, "part"), Check("regex", "p_brand", params={"pattern": "^Brand#[1-3][0-9]?$"}), filled="filled", bad="bad")


@query("SELECT count(p_name) AS filled, count(*) FILTER (NOT regexp_matches(p_name, '[13579]')) AS bad FROM part")
def regex_find(spark, sf_dir):
    return fused(table(spark, sf_dir, "part"), Check("regex", "p_name", params={"pattern": "[13579]"}), filled="filled", bad="bad")


_ADDRESS = "CASE WHEN c_custkey % 5 = 0 THEN replace(c_name, '#', '.') WHEN c_custkey % 17 = 0 THEN concat(replace(c_name, '#', '.'), '@example.com', chr(10)) ELSE concat(replace(c_name, '#', '.'), '@example.com') END"


@query(f"SELECT count(a) AS filled, count(*) FILTER (NOT regexp_matches(a, '{EMAIL}')) AS bad FROM (SELECT {_ADDRESS} AS a FROM customer)")
def email_customers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.expr(_ADDRESS).alias("a"))
    return fused(df, Check("email_validation", "a"), filled="filled", bad="bad")


_CATEGORIES = {
    "orders": (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "float"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")),
    "events": (("event_id", "integer"), ("ts", "timestamp"), ("user_id", "integer"), ("event_type", "string"), ("value", "float"), ("props", "string")),
    "embeddings": (("vec_id", "integer"), ("embedding", "array<float>"), ("label", "integer")),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{k}')" for t, cs in _CATEGORIES.items() for c, k in cs) + ") AS t(table_name, column_name, category)")
def schema_types(spark, sf_dir):
    """Metadata alone."""
    from .functions.scalars import column_category

    found = [(t, f.name, column_category(f.dataType)) for t in _CATEGORIES for f in table(spark, sf_dir, t).schema.fields]
    return spark.createDataFrame(found, "table_name string, column_name string, category string")


# --- freshness, volume, reference, custom -------------------------------------------


@query("SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)::TIMESTAMP)) / 1000000.0::DOUBLE AS age FROM events")
def freshness_events(spark, sf_dir):
    return fused(table(spark, sf_dir, "events"), Check("freshness", "ts"), age="age")


@query("SELECT count(s) AS pairs, avg(s) AS mean, max(s) AS most FROM (SELECT epoch(l_shipdate) - epoch(o_orderdate) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def latency_ship(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return fused(df, Check("latency", params={"source_column": "o_orderdate", "target_column": "l_shipdate"}), pairs="pairs", mean="mean", most="most")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS total FROM {t}" for t in _TABLES))
def row_count_all(spark, sf_dir):
    out = None
    for name in _TABLES:
        one = fused(table(spark, sf_dir, name), Check("row_count"), rows="total").select(F.lit(name).alias("table_name"), "total")
        out = one if out is None else out.unionByName(one)
    return out


def _reference(spark, sf_dir) -> Context:
    return Context(spark, resolve=lambda name: table(spark, sf_dir, name))


@query("SELECT count(*) AS orphans FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def ref_labels(spark, sf_dir):
    check = Check("referential_integrity", "doc_id", params={"reference_table": "labels", "reference_column": "doc_id"})
    return _orphans(table(spark, sf_dir, "documents"), check, _reference(spark, sf_dir)).agg(F.count(F.lit(1)).alias("orphans"))


@query(f"SELECT o_orderkey, c FROM (SELECT o_orderkey, {_ORPHANED} AS c FROM orders) o WHERE c IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = c)")
def ref_orders_faulted(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORPHANED).alias("c"))
    return _orphans(df, Check("referential_integrity", "c", params={"reference_table": "customer", "reference_column": "c_custkey"}), _reference(spark, sf_dir))


@query("SELECT min(l_quantity) > 0 AND max(l_discount) < 1 AS first FROM lineitem")
def custom_sql_bool(spark, sf_dir):
    view = "assayline_lineitem"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView(view)
    check = Check("custom_sql", params={"query": f"SELECT min(l_quantity) > 0 AND max(l_discount) < 1 FROM {view}"})
    return KINDS["custom_sql"].own(None, check, Context(spark))


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_NULLED} IS NULL ORDER BY o_orderkey LIMIT 5")
def failing_rows(spark, sf_dir):
    bad = KINDS["not_null"].failing(orders(spark, sf_dir), Check("not_null", "cust"), Context(spark))
    return bad.select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(5)


# --- history ------------------------------------------------------------------------

_DAILY = "SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS row_count, avg(value) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1"


def daily(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return events.groupBy("day").agg(*[WATCHED[m]("value").alias(m) for m in ("row_count", "mean", "min", "max")])


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS row_count, (count(*) FILTER (u IS NULL))::DOUBLE AS null_count, (count(*) FILTER (u IS NULL))::DOUBLE / count(*) AS null_rate, "
    "count(DISTINCT u)::DOUBLE AS distinct_count, avg(value) AS mean, min(value) AS min, max(value) AS max FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS u FROM events) GROUP BY 1"
)
def metrics_daily(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("u", F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END"))
    over = {m: "u" if m in ("null_count", "null_rate", "distinct_count") else "value" for m in WATCHED}
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[WATCHED[m](c).alias(m) for m, c in over.items()])


def _last_day(spark, sf_dir, method: str) -> DataFrame:
    """The last day's mean against the bounds that the days before it set, to 6 places."""
    series = daily(spark, sf_dir).select("day", F.col("mean").alias("x"))
    last = series.groupBy().agg(F.max_by("x", "day").alias("x"), F.max("day").alias("day"))
    past = series.join(F.broadcast(last.select(F.col("day").alias("last"))), F.col("day") < F.col("last")).select("x")
    bounds = anomaly.series_bounds(past, [], "x", method, 3.0)
    found = bounds.crossJoin(F.broadcast(last))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("x", "lower", "upper")], ((F.col("x") < F.col("lower")) | (F.col("x") > F.col("upper"))).alias("is_anomaly"))


_PAST = f"WITH daily AS ({_DAILY}), last_day AS (SELECT max_by(mean, day) AS x, max(day) AS day FROM daily), past AS (SELECT mean AS v FROM daily WHERE day < (SELECT day FROM last_day)), "
_OUT = " SELECT n, round(x, 6) AS x, round(lower_, 6) AS lower, round(upper_, 6) AS upper, x < lower_ OR x > upper_ AS is_anomaly FROM bounds, last_day"


@query(_PAST + "bounds AS (SELECT count(*) AS n, avg(v) - 3 * stddev_samp(v) AS lower_, avg(v) + 3 * stddev_samp(v) AS upper_ FROM past)" + _OUT)
def anomaly_zscore(spark, sf_dir):
    return _last_day(spark, sf_dir, "zscore")


@query(
    _PAST + "middle AS (SELECT median(v) AS m FROM past), bounds AS (SELECT count(*) AS n, any_value(m) - 3 * 1.4826::DOUBLE * median(abs(v - m)) AS lower_, "
    "any_value(m) + 3 * 1.4826::DOUBLE * median(abs(v - m)) AS upper_ FROM past, middle)" + _OUT
)
def anomaly_mad(spark, sf_dir):
    return _last_day(spark, sf_dir, "mad")


def _quartile_sql(k: int) -> str:
    j, n = f"greatest(1, least(({k} * (n + 1)) // 4, n - 1))", "(n + 1)"
    return f"sum(CASE WHEN r = {j} THEN v * (4 - ({k} * {n} - 4 * {j})) / 4 WHEN r = {j} + 1 THEN v * ({k} * {n} - 4 * {j}) / 4 END) AS q{k}"


@query(
    _PAST + "ranked AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM past), "
    f"quartiles AS (SELECT any_value(n) AS n, {_quartile_sql(1)}, {_quartile_sql(3)} FROM ranked), bounds AS (SELECT n, q1 - 3 * (q3 - q1) AS lower_, q3 + 3 * (q3 - q1) AS upper_ FROM quartiles)" + _OUT
)
def anomaly_iqr(spark, sf_dir):
    return _last_day(spark, sf_dir, "iqr")


@query(
    "SELECT strftime(day, '%Y-%m-%d') AS day, total, previous, round((total - previous) / previous::DOUBLE, 9) AS change, (total - previous) / previous::DOUBLE < -0.05 OR (total - previous) / previous::DOUBLE > 0.05 AS fails "
    "FROM (SELECT day, total, lag(total) OVER (ORDER BY day) AS previous FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM events GROUP BY 1))"
)
def row_count_change_daily(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"))
    change = (F.col("total") - F.col("previous")) / F.col("previous")
    # One row a day: the window has as many rows as there are days.
    lagged = days.withColumn("previous", F.lag("total").over(W.orderBy("day")))
    return lagged.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "previous", F.round(change, 9).alias("change"), ((change < -0.05) | (change > 0.05)).alias("fails"))


# --- suites -------------------------------------------------------------------------

SUITE = Suite(
    "orders",
    Source(table="orders"),
    (
        Check("not_null", "cust"),
        Check("not_null", "o_orderkey"),
        Check("completeness", "cust", params={"min": 0.95}),
        Check("accepted_values", "status", params={"values": ["F", "O", "P"]}, severity="warning"),
        Check("range", "o_totalprice", params={"min": 0}),
        Check("row_count", params={"min": 1}),
        Check("unique", "o_orderkey"),
        Check("freshness", "o_orderdate", params={"max_age": "9000d"}, severity="info"),
    ),
)


@query(
    f"SELECT count(*) AS m0, count(*) FILTER ({_NULLED} IS NULL) AS m1, count(*) FILTER (o_orderkey IS NULL) AS m2, count({_NULLED}) AS m3, count({_BAD_STATUS}) AS m4, "
    f"count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS m5, count(o_totalprice) AS m6, count(*) FILTER (o_totalprice < 0) AS m7, min(o_totalprice) AS m8, max(o_totalprice) AS m9, "
    "epoch(TIMESTAMP '2024-02-01') - epoch(max(o_orderdate)) AS m10 FROM orders"
)
def batch_orders(spark, sf_dir):
    """All metrics of a suite that need no DISTINCT, in one row by one job."""
    df = orders(spark, sf_dir)
    context = Context(spark, as_of=AS_OF, frame=df)
    (job,) = plan(df, list(SUITE.checks), context).jobs()
    return df.agg(*[c.alias(a) for a, c in job.items()])


@query(
    "WITH o AS (SELECT count(*) AS n, "
    f"count(*) FILTER ({_NULLED} IS NULL) AS nulls, count({_NULLED})::DOUBLE / count(*) AS share, count(*) FILTER ({_BAD_STATUS} NOT IN ('F', 'O', 'P')) AS bad, count(DISTINCT o_orderkey) AS keys FROM orders), "
    "checked AS (SELECT unnest([{'w': 1.0::DOUBLE, 'good': nulls = 0}, {'w': 1.0::DOUBLE, 'good': true}, {'w': 1.0::DOUBLE, 'good': share >= 0.95}, {'w': 0.5::DOUBLE, 'good': true}, "
    "{'w': 1.0::DOUBLE, 'good': true}, {'w': 1.0::DOUBLE, 'good': n >= 1}, {'w': 1.0::DOUBLE, 'good': n = keys}, {'w': 0.25::DOUBLE, 'good': true}], recursive := true) FROM o) "
    "SELECT 'orders' AS suite, count(*) AS total, count(*) FILTER (NOT good) AS failed, round(100 * sum(CASE WHEN good THEN w ELSE 0 END) / sum(w), 1) AS quality_score FROM checked"
)
def suite_score(spark, sf_dir):
    """The suite's weighted score; a failed warning counts as warned, and so as good."""
    result = Engine(spark, as_of=AS_OF).run_suite(SUITE, orders(spark, sf_dir), samples=False)
    s = result.summary()
    return spark.createDataFrame([(s["suite"], s["total"], s["failed"] + s["errored"], s["quality_score"])], "suite string, total long, failed long, quality_score double")


# --- profiles and contracts ---------------------------------------------------------


@query(
    "SELECT count(*) AS total, count(*) - count(o_totalprice) AS nulls, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, "
    "round(stddev_samp(o_totalprice), 4) AS stddev, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders"
)
def profile_numeric(spark, sf_dir):
    found = profile.numeric_stats(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.select("total", "nulls", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "median")])


@query("SELECT count(*) AS total, count(*) - count(text) AS nulls, min(length(text)) AS min_length, max(length(text)) AS max_length, avg(length(text)) AS mean_length FROM documents")
def profile_string(spark, sf_dir):
    return profile.string_stats(table(spark, sf_dir, "documents"), "text")


@query("SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def profile_topk(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "part"), "p_type")


@query(f"SELECT (count({_NULLED}) + count(o_orderkey) + count(o_totalprice))::BIGINT AS filled, (3 * count(*))::BIGINT AS cells FROM orders")
def contract_completeness(spark, sf_dir):
    return pooled_completeness(orders(spark, sf_dir), ["cust", "o_orderkey", "o_totalprice"])


# --- windows of event time, in batch form -------------------------------------------



def _by_window(spark, sf_dir, window) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("v", F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END"))
    metrics = {"total": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "most": F.max("v")}
    return windows.windowed(df, window, metrics)


_EVENTS = "SELECT *, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events"
_AGGS = "count(*) AS total, count(*) FILTER (v IS NULL) AS nulls, max(v) AS most"


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, {_AGGS} FROM ({_EVENTS}) GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    return _by_window(spark, sf_dir, windows.tumbling("ts", "1 day"))


@query(
    f"SELECT w AS window_start, w + INTERVAL 2 DAY AS window_end, {_AGGS} FROM (SELECT v, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM ({_EVENTS})) GROUP BY 1, 2"
)
def window_sliding(spark, sf_dir):
    return _by_window(spark, sf_dir, windows.sliding("ts", "2 days", "1 day"))


@query(
    f"SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, {_AGGS} FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM "
    f"(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ({_EVENTS}))) GROUP BY user_id, s"
)
def window_session(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END"))
    metrics = {"total": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "most": F.max("v")}
    return windows.windowed(df, windows.session("ts", "6 hours"), metrics, ["user_id"])


@query("SELECT event_id, epoch(ts) AS seconds FROM events")
def epoch_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", epoch_seconds(F.col("ts")).alias("seconds"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite over orders, a row for each check."""
    return Engine(spark, as_of=AS_OF).run_suite(SUITE, orders(spark, sf_dir)).frame(spark)
