"""Running suites: plan, aggregate, judge, sample what fails, score."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Check, CheckResult, Config, Source, Status, Suite, SuiteResult, utc_now
from ..operators.checks import KINDS, Context, severity_of
from ..sources.resolve import resolve
from .planner import Plan, expanded, plan

#: Failing rows that a result shows.
SAMPLE = 5


def quoted_name(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col(f"`{name.replace('`', '``')}`")


def _reason(error: BaseException) -> str:
    return str(error).split("\n")[0][:500] or type(error).__name__


def _error(check: Check, reason: str, table: str) -> CheckResult:
    return CheckResult(check, Status.ERROR, severity_of(check), f"error: {reason}", table=table)


def _values(df: DataFrame, check: Check, context: Context) -> dict[str, Any]:
    """A check's metrics by a job of its own, or from the schema."""
    kind = KINDS[check.type]
    if kind.metadata:
        return kind.metadata(df, check)
    frame = kind.own(df, check, context) if kind.own else df.agg(*[c.alias(n) for n, c in kind.fused(check, context).items()])
    row = frame.first()
    return row.asDict() if row is not None else {}


def _sample(df: DataFrame, check: Check, context: Context) -> tuple[str, ...]:
    """The first failing rows as JSON, in an order that the rows alone decide: by their
    columns, as far as these have an order. Only the rows shown are written as JSON."""
    kind = KINDS[check.type]
    if kind.failing is None:
        return ()
    bad = kind.failing(df, check, context)
    keys = [quoted_name(f.name) for f in bad.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = bad.orderBy(*keys).limit(SAMPLE) if keys else bad.limit(SAMPLE)
    return tuple(r["row"] for r in first.select(F.to_json(F.struct(*[quoted_name(c) for c in first.columns])).alias("row")).collect())


def _judge(df: DataFrame, check: Check, values: dict[str, Any], context: Context, samples: bool, began: float) -> CheckResult:
    verdict = KINDS[check.type].verdict(check, values, context)
    sample = _sample(df, check, context) if samples and verdict.status is Status.FAIL else ()
    return CheckResult(
        check, verdict.status, severity_of(check), verdict.observed, verdict.expected, verdict.row_count, verdict.failing_rows,
        sample, verdict.metrics, context.table, round(1000 * (time.time() - began)),
    ).downgraded()


def run_checks(df: DataFrame, checks: tuple[Check, ...] | list[Check], context: Context, fuse: bool = True, samples: bool = True, parallel: int = 4) -> list[CheckResult]:
    """A result for every check, in their order, whatever happens to any of them.

    Fused metrics run as one job; checks with a job of their own are submitted from a few
    threads, so that small jobs don't wait for each other.
    """
    checks = expanded(tuple(checks))
    context.frame = df
    plans: Plan = plan(df, checks, context, fuse)
    results: dict[int, CheckResult] = {k: _error(checks[k], reason, context.table) for k, reason in plans.errors.items()}
    began = time.time()
    found: dict[str, Any] = {}
    broken = False
    if fuse:
        try:
            for job in plans.jobs():
                found |= df.agg(*[c.alias(a) for a, c in job.items()]).first().asDict()
        except Exception:
            broken = True  # one value that can't be computed; each check then runs alone

    def one(place: int) -> CheckResult:
        check, start = checks[place], time.time()
        try:
            if place in plans.names and fuse and not broken:
                values, start = {n: found[a] for n, a in plans.names[place].items()}, began
            else:
                values = _values(df, check, context)
            return _judge(df, check, values, context, samples, start)
        except Exception as e:
            return _error(check, _reason(e), context.table)

    places = [k for k in range(len(checks)) if k not in results]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        results |= dict(zip(places, pool.map(one, places), strict=True))
    return [results[k] for k in range(len(checks))]


@dataclass
class Engine:
    """Runs the suites of a configuration; a store, if given, keeps results and history."""

    spark: SparkSession
    config: Config = Config()
    store: Any = None
    as_of: datetime | None = None

    def context(self, suite: Suite, table: str) -> Context:
        history: Callable[[str, str, int], list[float]] | None = None
        if self.store is not None:
            history = lambda check, metric, n: self.store.history(suite.name, check, metric, n)

        def other(name: str) -> DataFrame:
            if name in self.config.sources:
                return resolve(self.spark, self.config.sources[name])
            if isinstance(suite.source, Source) and suite.source.connection:
                return resolve(self.spark, replace(suite.source, table=name))
            return resolve(self.spark, Source(table=name))

        return Context(self.spark, table, suite.name, self.as_of, other, history)

    def run_suite(self, suite: Suite, frame: Any = None, fuse: bool = True, samples: bool = True, parallel: int = 4) -> SuiteResult:
        """A frame, if given, stands for the suite's source."""
        started, began = utc_now(), time.time()
        table = suite.source.table
        context = self.context(suite, table)
        try:
            df = resolve(self.spark, suite.source if frame is None else frame)
            results = run_checks(df, suite.checks, context, fuse, samples, parallel)
        except Exception as e:
            results = [_error(c, _reason(e), table) for c in expanded(suite.checks)]
        out = SuiteResult(suite.name, tuple(results), started, round(1000 * (time.time() - began)))
        if self.store is not None:
            self.store.save(out)
        return out

    def run(self, suites: list[str] | None = None, tags: list[str] | None = None, **options: Any) -> list[SuiteResult]:
        chosen = [s for s in self.config.suites if (not suites or s.name in suites) and (not tags or set(tags) & set(s.tags))]
        return [self.run_suite(s, **options) for s in chosen]


def check_frame(df: DataFrame, checks: list[Any], name: str = "frame", as_of: datetime | None = None, **options: Any) -> SuiteResult:
    """Checks, as dataclasses or in the configuration's notation, against one DataFrame."""
    from .config import parse_check

    suite = Suite(name, Source(table=name), tuple(c if isinstance(c, Check) else parse_check(c) for c in checks))
    return Engine(df.sparkSession, as_of=as_of).run_suite(suite, df, **options)
