"""The kinds of checks.

A kind declares its metrics as Spark aggregates, a verdict over their values and the rows
that fail. Metrics without DISTINCT (``fused``) are computed for all checks of a table in
one aggregation; those that need a job of their own (``own``) return one row each. The
verdict is the same for the fused, the single and the streaming path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import column_category, duration_text, fraction_of, seconds_between, seconds_of, type_category
from ..model import Check, Severity, Status
from . import anomaly
from .pairs import counted

#: Local part, at sign, host with a top-level domain of letters; ``\z`` so that no line end may follow.
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\z"


class CheckError(ValueError):
    """A check that can't be run as it is written."""


@dataclass(frozen=True)
class Verdict:
    status: Status
    observed: str = ""
    expected: str = ""
    row_count: int | None = None
    failing_rows: int | None = None
    metrics: dict[str, float] = field(default_factory=dict)


@dataclass
class Context:
    """What checks know besides their table's rows: its columns' types (``frame``), other
    tables, the clock, earlier values."""

    spark: SparkSession
    table: str = ""
    suite: str = ""
    as_of: datetime | None = None
    resolve: Callable[[str], DataFrame] | None = None
    history: Callable[[str, str, int], list[float]] | None = None
    frame: DataFrame | None = None

    def other(self, name: str) -> DataFrame:
        return self.resolve(name) if self.resolve else self.spark.table(name)

    def now(self) -> Column:
        return F.lit(self.as_of.isoformat(sep=" ")).cast("timestamp_ntz") if self.as_of else F.current_timestamp().cast("timestamp_ntz")


Metrics = dict[str, Column]
Values = dict[str, Any]


@dataclass(frozen=True)
class Kind:
    name: str
    verdict: Callable[[Check, Values, Context], Verdict]
    fused: Callable[[Check, Context], Metrics] | None = None
    own: Callable[[DataFrame, Check, Context], DataFrame] | None = None
    metadata: Callable[[DataFrame, Check], Values] | None = None
    failing: Callable[[DataFrame, Check, Context], DataFrame] | None = None
    alone: Callable[[Check], bool] | None = None
    severity: Severity = Severity.CRITICAL

    def shares(self, check: Check) -> bool:
        """Whether a check's metrics join the aggregation of the others."""
        return self.fused is not None and not (self.alone and self.alone(check))


KINDS: dict[str, Kind] = {}


def register(kind: Kind) -> Kind:
    """Adds a kind; a later one of the same name takes its place."""
    KINDS[kind.name] = kind
    return kind


def register_plugin(kind: Kind) -> None:
    """Adds a kind from elsewhere, which can't take a built-in one's place."""
    if kind.name in _BUILT_IN:
        raise ValueError(f"{kind.name} is built in")
    register(kind)


def severity_of(check: Check) -> Severity:
    """The check's own severity, or that of its kind."""
    if check.severity:
        return Severity(check.severity)
    return KINDS[check.type].severity if check.type in KINDS else Severity.CRITICAL


def column_of(check: Check) -> str:
    name = check.column or (check.columns[0] if check.columns else "")
    if not name:
        raise CheckError(f"No column specified for {check.type} check")
    return name


def quoted(name: str) -> Column:
    """A column by its name; dots lead into structs."""
    return F.col(".".join(f"`{part.replace('`', '``')}`" for part in name.split(".")))


def _outcome(bad: int, observed: str, expected: str, rows: int) -> Verdict:
    return Verdict(Status.FAIL if bad else Status.PASS, observed, expected, rows, bad, {"fail_rate": bad / rows if rows else 0.0})


def rows() -> Column:
    return F.count(F.lit(1))


# --- completeness -------------------------------------------------------------------


def _null_metrics(check: Check, _: Context) -> Metrics:
    c = quoted(column_of(check))
    return {"rows": rows(), "nulls": F.count_if(c.isNull())}


def _not_null(check: Check, v: Values, _: Context) -> Verdict:
    share = v["nulls"] / v["rows"] if v["rows"] else 0.0
    return Verdict(Status.FAIL if v["nulls"] else Status.PASS, f"{v['nulls']} nulls", "0 nulls", v["rows"], v["nulls"], {"null_count": v["nulls"], "fail_rate": share})


register(Kind("not_null", _not_null, fused=_null_metrics, failing=lambda df, check, _: df.filter(quoted(column_of(check)).isNull())))


def _completeness(check: Check, v: Values, _: Context) -> Verdict:
    least = fraction_of(check.params.get("min", 0.95))
    share = v["filled"] / v["rows"] if v["rows"] else 0.0
    return Verdict(Status.PASS if share >= least else Status.FAIL, f"{share:.1%}", f">= {least:.1%}", v["rows"], v["rows"] - v["filled"], {"completeness_pct": 100 * share})


register(
    Kind(
        "completeness",
        _completeness,
        fused=lambda check, _: {"rows": rows(), "filled": F.count(quoted(column_of(check)))},
        failing=lambda df, check, _: df.filter(quoted(column_of(check)).isNull()),
    )
)


# --- uniqueness ---------------------------------------------------------------------


def _keys(check: Check) -> list[Column]:
    names = check.columns or ((check.column,) if check.column else ())
    if not names:
        raise CheckError(f"No columns specified for {check.type} check")
    return [quoted(n) for n in names]


def _all_set(keys: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])


def _surplus(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows with whole keys and those beyond the first of each key; grouping pre-aggregates."""
    named = [k.alias(f"k{n}") for n, k in enumerate(keys)]
    groups = df.filter(_all_set(keys)).select(*named).groupBy(*[f"k{n}" for n in range(len(keys))]).agg(rows().alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.coalesce(F.sum("n"), F.lit(0)) - rows()).alias("surplus"))


def _duplicated(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that more than one row has, with how many, most first."""
    named = [k.alias(f"key_{n}") for n, k in enumerate(keys)]
    names = [f"key_{n}" for n in range(len(keys))]
    return df.filter(_all_set(keys)).select(*named).groupBy(*names).agg(rows().alias("rows")).filter("rows > 1").orderBy(F.desc("rows"), *names)


for _name, _of in (("unique", lambda check: [quoted(column_of(check))]), ("unique_combination", _keys)):
    register(
        Kind(
            _name,
            lambda check, v, _: _outcome(v["surplus"], f"{v['surplus']} duplicates", "0 duplicates", v["rows"]),
            own=lambda df, check, _, of=_of: _surplus(df, of(check)),
            failing=lambda df, check, _, of=_of: _duplicated(df, of(check)),
        )
    )


# --- validity -----------------------------------------------------------------------


def _accepted(check: Check) -> list[Any]:
    values = check.params.get("values") or []
    if not values:
        raise CheckError("No accepted values specified")
    return list(values)


def _not_accepted(df: DataFrame, check: Check) -> Column:
    """Set, and equal to no listed value as the column's type reads it; what it can't read matches nothing."""
    c, values = quoted(column_of(check)), _accepted(check)
    # Fields of structs are left to the analyser.
    kind = next((f.dataType for f in df.schema.fields if f.name == column_of(check)), None) or df.select(c).schema[0].dataType
    if kind.typeName() not in ("string", "varchar", "char", "boolean", "date", "timestamp", "timestamp_ntz", "byte", "short", "integer", "long", "float", "double", "decimal"):
        raise CheckError(f"accepted_values can't compare {kind.simpleString()}")
    listed = [F.lit(str(v).lower() if isinstance(v, bool) else str(v)).try_cast(kind) for v in values]
    hit = reduce(lambda a, b: a | b, [F.coalesce(c == v, F.lit(False)) for v in listed])
    return c.isNotNull() & ~hit


register(
    Kind(
        "accepted_values",
        lambda check, v, _: _outcome(v["bad"], f"{v['bad']} invalid values", f"only {_accepted(check)}", v["filled"]),
        fused=lambda check, ctx: {"filled": F.count(quoted(column_of(check))), "bad": F.count_if(_not_accepted(ctx.frame, check))},
        failing=lambda df, check, _: df.filter(_not_accepted(df, check)),
    )
)


def _bounds(check: Check) -> tuple[float | None, float | None]:
    out = []
    for key in ("min", "max"):
        value = check.params.get(key)
        try:
            out.append(None if value is None else float(value))
        except (TypeError, ValueError):
            raise CheckError(f"range {key} must be a number, not {value!r}") from None
    return out[0], out[1]


def _outside(check: Check) -> Column:
    c, (low, high) = quoted(column_of(check)), _bounds(check)
    sides = ([c < F.lit(low)] if low is not None else []) + ([c > F.lit(high)] if high is not None else [])
    return reduce(lambda a, b: a | b, sides) if sides else F.lit(False)


def _range(check: Check, v: Values, _: Context) -> Verdict:
    low, high = _bounds(check)
    expected = ", ".join(f"{k}={x}" for k, x in (("min", low), ("max", high)) if x is not None)
    return _outcome(v["bad"], f"min={v['least']}, max={v['most']}", expected, v["filled"])


register(
    Kind(
        "range",
        _range,
        fused=lambda check, _: {"filled": F.count(quoted(column_of(check))), "bad": F.count_if(_outside(check)), "least": F.min(quoted(column_of(check))), "most": F.max(quoted(column_of(check)))},
        failing=lambda df, check, _: df.filter(_outside(check)),
    )
)


def _pattern(check: Check) -> str:
    if check.type == "email_validation":
        return EMAIL
    pattern = check.params.get("pattern")
    if not pattern:
        raise CheckError("No pattern specified for regex check")
    return str(pattern)


def _unmatched(check: Check) -> Column:
    return ~quoted(column_of(check)).cast("string").rlike(_pattern(check))


for _name, _noun in (("regex", "non-matching"), ("email_validation", "invalid emails")):
    register(
        Kind(
            _name,
            lambda check, v, _, noun=_noun: _outcome(v["bad"], f"{v['bad']} {noun}", f"matches /{_pattern(check)}/" if check.type == "regex" else "valid email addresses", v["filled"]),
            fused=lambda check, _: {"filled": F.count(quoted(column_of(check))), "bad": F.count_if(_unmatched(check))},
            failing=lambda df, check, _: df.filter(_unmatched(check)),
            severity=Severity.WARNING,
        )
    )


def _type_values(df: DataFrame, check: Check) -> Values:
    name = column_of(check).lower()
    found = next((f for f in df.schema.fields if f.name.lower() == name), None)
    return {"actual": found and found.dataType.simpleString(), "category": found and column_category(found.dataType)}


def _type_verdict(check: Check, v: Values, _: Context) -> Verdict:
    expected = str(check.params.get("expected", check.params.get("value", "")))
    if v["actual"] is None:
        return Verdict(Status.ERROR, f"column '{column_of(check)}' not found", expected)
    return Verdict(Status.PASS if v["category"] == type_category(expected) else Status.FAIL, v["actual"], expected)


register(Kind("type", _type_verdict, metadata=_type_values))


# --- freshness ----------------------------------------------------------------------


def _age(check: Check, v: Values, _: Context) -> Verdict:
    limit = str(check.params.get("max_age", "24h"))
    if v["age"] is None:
        return Verdict(Status.FAIL, "no data", f"< {limit}")
    age = int(v["age"])
    return Verdict(Status.PASS if age <= seconds_of(limit) else Status.FAIL, f"{duration_text(age)} ago", f"< {limit}", metrics={"age_seconds": float(age)})


register(Kind("freshness", _age, fused=lambda check, ctx: {"age": seconds_between(F.max(quoted(column_of(check))).cast("timestamp_ntz"), ctx.now())}))


def _lag(check: Check) -> Column:
    source = check.params.get("source_column") or check.column
    target = check.params.get("target_column")
    if not source:
        raise CheckError("source_column parameter is required")
    if not target:
        raise CheckError("target_column parameter is required")
    return seconds_between(quoted(source).cast("timestamp_ntz"), quoted(target).cast("timestamp_ntz"))


def _latency(check: Check, v: Values, _: Context) -> Verdict:
    limit = str(check.params.get("max_latency", "1h"))
    if not v["pairs"]:
        return Verdict(Status.FAIL, "no data", f"< {limit}")
    text = f"avg={duration_text(int(v['mean']))}, max={duration_text(int(v['most']))}"
    return Verdict(Status.PASS if v["most"] <= seconds_of(limit) else Status.FAIL, text, f"< {limit}", v["pairs"], metrics={"max_latency": v["most"]})


register(
    Kind(
        "latency",
        _latency,
        fused=lambda check, _: {"pairs": F.count(_lag(check)), "mean": F.avg(_lag(check)), "most": F.max(_lag(check))},
        failing=lambda df, check, _: df.filter(_lag(check) > seconds_of(str(check.params.get("max_latency", "1h")))),
        severity=Severity.WARNING,
    )
)


#: Kinds that judge a row by itself: the condition under which it fails, null where it can't be said.
ROW_TESTS: dict[str, Callable[[DataFrame, Check], Column]] = {
    "not_null": lambda df, check: quoted(column_of(check)).isNull(),
    "range": lambda df, check: _outside(check),
    "accepted_values": _not_accepted,
    "regex": lambda df, check: _unmatched(check),
    "email_validation": lambda df, check: _unmatched(check),
    "latency": lambda df, check: _lag(check) > seconds_of(str(check.params.get("max_latency", "1h"))),
}


# --- volume, reference, custom ------------------------------------------------------


def _row_count(check: Check, v: Values, _: Context) -> Verdict:
    low, high = check.params.get("min"), check.params.get("max")
    parts = [f"{sign} {int(x):,}" for sign, x in ((">=", low), ("<=", high)) if x is not None]
    good = v["rows"] >= (low or 0) and (high is None or v["rows"] <= high)
    return Verdict(Status.PASS if good else Status.FAIL, f"{v['rows']:,}", " and ".join(parts) or ">= 0 (any)", v["rows"], metrics={"row_count": v["rows"]})


register(Kind("row_count", _row_count, fused=lambda check, _: {"rows": rows()}))


def _orphans(df: DataFrame, check: Check, ctx: Context) -> DataFrame:
    """Rows whose set key has no equal in the reference; Catalyst and AQE choose the join."""
    table, column = check.params.get("reference_table"), check.params.get("reference_column")
    if not check.column:
        raise CheckError("missing required parameter: column")
    if not table:
        raise CheckError("missing required parameter: reference_table")
    if not column:
        raise CheckError("missing required parameter: reference_column")
    keys = ctx.other(table).select(quoted(column).alias("__reference")).distinct()
    key = quoted(check.column)
    return df.filter(key.isNotNull()).join(keys, key == F.col("__reference"), "left_anti")


register(
    Kind(
        "referential_integrity",
        lambda check, v, _: _outcome(v["orphans"], f"{v['orphans']} orphaned rows", "0 orphaned rows", v["rows"]),
        own=lambda df, check, ctx: _orphans(df, check, ctx).agg(rows().alias("orphans")).crossJoin(df.agg(F.count(quoted(check.column)).alias("rows"))),
        failing=_orphans,
    )
)


def _custom(check: Check, v: Values, _: Context) -> Verdict:
    if "first" not in v:
        return Verdict(Status.ERROR, "Query returned no results", "True")
    return Verdict(Status.PASS if v["first"] else Status.FAIL, str(v["first"]), "True")


def _query(df: DataFrame, check: Check, ctx: Context) -> DataFrame:
    query = str(check.params.get("query") or "").strip()
    if not query:
        raise CheckError("No query provided. Use custom_sql: SELECT ...")
    out = counted(ctx.spark.sql(query))
    return out.select(out[out.columns[0]].alias("first")).limit(1) if len(set(out.columns)) == len(out.columns) else out.toDF("first", *[f"c{k}" for k in range(1, len(out.columns))]).limit(1)


register(Kind("custom_sql", _custom, own=_query))


# --- history ------------------------------------------------------------------------

#: What the anomaly check can watch.
WATCHED: dict[str, Callable[[str], Column]] = {
    "row_count": lambda c: rows().cast("double"),
    "null_count": lambda c: F.count_if(quoted(c).isNull()).cast("double"),
    "null_rate": lambda c: F.coalesce(F.try_divide(F.count_if(quoted(c).isNull()), rows()), F.lit(0.0)),
    "distinct_count": lambda c: F.count_distinct(quoted(c)).cast("double"),
    "mean": lambda c: F.avg(quoted(c)).cast("double"),
    "min": lambda c: F.min(quoted(c)).cast("double"),
    "max": lambda c: F.max(quoted(c)).cast("double"),
}


def _watched(check: Check) -> Column:
    metric = check.params.get("metric")
    if not metric:
        raise CheckError("'metric' parameter is required")
    if metric not in WATCHED:
        raise CheckError(f"Unsupported metric '{metric}'")
    if metric != "row_count" and not check.column:
        raise CheckError(f"metric '{metric}' needs a column")
    return WATCHED[metric](check.column or "")


def history_key(check: Check) -> tuple[str, str]:
    """Under which check and metric a historical check stores and finds its values."""
    if check.type == "row_count_change":
        return "row_count_change", "row_count"
    return f"anomaly:{check.column or ''}", str(check.params.get("metric"))


def _anomalous(check: Check, v: Values, ctx: Context) -> Verdict:
    method, sensitivity = str(check.params.get("method", "mad")), str(check.params.get("sensitivity", "medium"))
    now = v["value"]
    if now is None:
        return Verdict(Status.ERROR, f"Unsupported metric '{check.params['metric']}' or no data")
    kept = {str(check.params["metric"]): float(now)}
    past = ctx.history(*history_key(check), 30) if ctx.history else []
    if len(past) < anomaly.LEAST_POINTS:
        return Verdict(Status.SKIP, f"{now} (no history available)" if not past else f"{now} ({len(past)} of {anomaly.LEAST_POINTS} points)", f"method={method}, sensitivity={sensitivity}", metrics=kept)
    found = anomaly.detect(method, past, now, sensitivity, check.params.get("threshold"))
    return Verdict(Status.FAIL if found.is_anomaly else Status.PASS, f"{now} (score={found.score})", f"[{found.lower:.2f}, {found.upper:.2f}]", metrics=kept)


register(
    Kind(
        "anomaly",
        _anomalous,
        fused=lambda check, _: {"value": _watched(check)},
        own=lambda df, check, _: df.agg(_watched(check).alias("value")),
        # A distinct count in the shared job would expand every row.
        alone=lambda check: check.params.get("metric") == "distinct_count",
        severity=Severity.WARNING,
    )
)


def _changed(check: Check, v: Values, ctx: Context) -> Verdict:
    now, kept = v["rows"], {"row_count": float(v["rows"])}
    fall, rise = fraction_of(str(check.params.get("max_decrease", "50%"))), fraction_of(str(check.params.get("max_increase", "500%")))
    if not ctx.history:
        return Verdict(Status.SKIP, f"{now:,} rows (no history available)", row_count=now, metrics=kept)
    past = ctx.history(*history_key(check), 1)
    if not past:
        return Verdict(Status.PASS, f"{now:,} rows (first run)", "no previous data", now, metrics=kept)
    if not past[0]:
        return Verdict(Status.PASS, f"{now:,} rows", "previous was 0", now, metrics=kept)
    change = (now - past[0]) / past[0]
    bad = change < -fall or change > rise
    return Verdict(Status.FAIL if bad else Status.PASS, f"{now:,} rows ({change:+.1%} from {past[0]:,.0f})", f"change within -{fall:.0%} to +{rise:.0%}", now, metrics=kept)


register(Kind("row_count_change", _changed, fused=lambda check, _: {"rows": rows()}, severity=Severity.WARNING))

_BUILT_IN = frozenset(KINDS)
