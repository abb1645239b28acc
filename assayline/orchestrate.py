"""Checks as steps of a workflow: a callable, a decorator for functions that make frames,
and an operator class where Airflow is installed."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import Status, SuiteResult
from .plans import config as configs
from .plans.engine import Engine, check_frame
from .sources.store import Store


class QualityError(RuntimeError):
    """A suite that failed; ``results`` has all of the run."""

    def __init__(self, results: list[SuiteResult]) -> None:
        bad = [f"{r.suite}: {x.check.name} {x.observed}" for r in results for x in r.results if x.status in (Status.FAIL, Status.ERROR)]
        super().__init__("; ".join(bad))
        self.results = results


def run_config(path: str, spark: SparkSession | None = None, suites: list[str] | None = None, tags: list[str] | None = None, store: str | None = None, strict: bool = True) -> list[dict[str, Any]]:
    """Runs a configuration's suites and returns their summaries; a failure raises if strict."""
    spark = spark or SparkSession.builder.getOrCreate()
    results = Engine(spark, configs.load(path), Store(spark, store) if store else None).run(suites, tags)
    if strict and any(r.status is Status.FAIL for r in results):
        raise QualityError(results)
    return [r.summary() for r in results]


def checked(*checks: Any, strict: bool = True) -> Callable:
    """Decorates a function that returns a DataFrame; what it returns is checked first."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> DataFrame:
            df = f(*args, **kwargs)
            result = check_frame(df, list(checks), f.__name__)
            if strict and result.status is Status.FAIL:
                raise QualityError([result])
            return df

        return call

    return wrap


try:
    from airflow.models import BaseOperator
except ImportError:
    BaseOperator = None

if BaseOperator is not None:

    class QualityOperator(BaseOperator):
        """Runs a configuration as an Airflow task and returns the summaries."""

        template_fields = ("path",)

        def __init__(self, path: str, suites: list[str] | None = None, tags: list[str] | None = None, store: str | None = None, strict: bool = True, **kwargs: Any) -> None:
            super().__init__(**kwargs)
            self.path, self.suites, self.tags, self.store, self.strict = path, suites, tags, store, strict

        def execute(self, context: Any) -> list[dict[str, Any]]:
            return run_config(self.path, None, self.suites, self.tags, self.store, self.strict)
