"""Checks over windows of event time, the same for batches and streams.

The metrics are those of the batch checks; a window's verdict comes from the same
function. Late rows are waited for as long as the watermark says. Checks that need
distinct values, joins or history of the whole table are rejected when they are planned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import seconds_between
from ..model import Check, CheckResult
from ..operators import anomaly
from ..operators.checks import KINDS, ROW_TESTS, CheckError, Context, quoted, severity_of
from ..plans.planner import expanded, kind_of

#: Checks that a window can't answer.
BATCH_ONLY = ("unique", "unique_combination", "referential_integrity", "custom_sql", "anomaly", "row_count_change", "freshness", "type")


def read_stream(spark: SparkSession, kind: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """A stream of files, Kafka messages or another of Spark's sources."""
    reader = spark.readStream.format(kind).options(**{k: v for k, v in options.items() if k != "path"})
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(options["path"]) if "path" in options else reader.load()


def tumbling(time: str, size: str) -> Column:
    return F.window(quoted(time), size)


def sliding(time: str, size: str, step: str) -> Column:
    return F.window(quoted(time), size, step)


def session(time: str, gap: str) -> Column:
    return F.session_window(quoted(time), gap)


def windowed(df: DataFrame, window: Column, metrics: dict[str, Column], keys: list[str] | None = None, time: str | None = None, watermark: str | None = None) -> DataFrame:
    """Metrics by window and keys: window_start, window_end, keys and metrics."""
    if watermark is not None:
        df = df.withWatermark(time, watermark)
    keys = keys or []
    out = df.groupBy(window.alias("window"), *[quoted(k).alias(k) for k in keys]).agg(*[c.alias(n) for n, c in metrics.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *metrics)


def check_metrics(df: DataFrame, checks: list[Check], context: Context) -> dict[str, Column]:
    """The fused metrics of checks of ``df``, whose types they go by, named by check and metric."""
    out, context = {}, replace(context, frame=df)
    for place, check in enumerate(expanded(tuple(checks))):
        if check.type in BATCH_ONLY or not kind_of(check).shares(check):
            raise CheckError(f"{check.type} needs the whole table and can't be run on windows")
        out |= {f"c{place}_{n}": c for n, c in KINDS[check.type].fused(check, context).items()}
    return out


def verdicts(row: dict[str, Any], checks: list[Check], context: Context) -> list[CheckResult]:
    """What the checks say about one window's metrics."""
    out = []
    for place, check in enumerate(expanded(tuple(checks))):
        kind = KINDS[check.type]
        values = {n.removeprefix(f"c{place}_"): v for n, v in row.items() if n.startswith(f"c{place}_")}
        v = kind.verdict(check, values, context)
        out.append(CheckResult(check, v.status, severity_of(check), v.observed, v.expected, v.row_count, v.failing_rows, metrics=v.metrics).downgraded())
    return out


def watch(
    stream: DataFrame,
    window: Column,
    checks: list[Check],
    time: str,
    watermark: str,
    on_window: Callable[[Any, list[CheckResult]], None],
    checkpoint: str,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Starts a query that judges every closed window once and hands it over.

    Only a window's metrics come to the driver, some ten numbers for each check.
    """
    context = Context(stream.sparkSession)
    metrics = windowed(stream, window, check_metrics(stream, checks, context), time=time, watermark=watermark)

    def batch(df: DataFrame, _: int) -> None:
        for row in df.orderBy("window_start").toLocalIterator():
            on_window(row, verdicts(row.asDict(), checks, context))

    return metrics.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**trigger or {"availableNow": True}).start()


def anomalous(metrics: DataFrame, value: str, history: DataFrame, method: str = "mad", limit: float = 3.0) -> DataFrame:
    """Closed windows with the bounds that earlier values of the metric set, and whether
    they lie outside; null with too short a history. ``history`` has the column ``value``,
    as a store's series has, and its bounds are one row."""
    bounds = anomaly.series_bounds(history.select(F.col(value) if value in history.columns else F.col("value").alias(value)), [], value, method, limit)
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return metrics.crossJoin(F.broadcast(bounds.select("lower", "upper"))).withColumn("is_anomaly", outside)


def messages(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON messages against a schema: the parsed struct and whether it could be parsed."""
    parsed = F.from_json(quoted(column), schema, {"mode": "PERMISSIVE"})
    return df.withColumn("parsed", parsed).withColumn("valid", F.try_parse_json(quoted(column)).isNotNull() & F.col("parsed").isNotNull())


def judged(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Each row, or message, with the checks that it fails by itself (``failed``, their names
    in the order of the checks) and whether it fails none (``passes``).

    Checks that judge a row alone are not_null, range, accepted_values, regex,
    email_validation and latency; others are rejected. A null fails not_null only.
    """
    tests = []
    for check in expanded(tuple(checks)):
        if check.type not in ROW_TESTS:
            raise CheckError(f"{check.type} doesn't judge single rows")
        tests.append(F.when(F.coalesce(ROW_TESTS[check.type](df, check), F.lit(False)), F.lit(check.name)))
    failed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return df.withColumn("failed", failed).withColumn("passes", F.size("failed") == 0)


def processing_lag(df: DataFrame, time: str, now: Column | None = None) -> DataFrame:
    """``lag_seconds``: from a row's event time to the time it is processed, the batch's own
    time in a stream, unless ``now`` is given."""
    moment = now if now is not None else F.current_timestamp()
    return df.withColumn("lag_seconds", seconds_between(quoted(time).cast("timestamp_ntz"), moment.cast("timestamp_ntz")))
