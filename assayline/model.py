"""What the engine passes around: sources, checks, suites, results, contracts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Status(StrEnum):
    PASS = "pass"
    FAIL = "fail"
    WARN = "warn"
    ERROR = "error"
    SKIP = "skip"


class Severity(StrEnum):
    INFO = "info"
    WARNING = "warning"
    CRITICAL = "critical"
    BLOCKER = "blocker"


#: What a check counts in the quality score.
WEIGHTS = {Severity.INFO: 0.25, Severity.WARNING: 0.5, Severity.CRITICAL: 1.0, Severity.BLOCKER: 1.0}


@dataclass(frozen=True)
class Source:
    """Where a table is: a type, a connection string, a table name or file function."""

    type: str = "spark"
    connection: str = ""
    table: str = ""
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Check:
    type: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict)
    severity: str | None = None

    @property
    def name(self) -> str:
        on = self.column or ", ".join(self.columns)
        return f"{self.type}:{on}" if on else self.type


@dataclass(frozen=True)
class Suite:
    name: str
    source: Source = Source()
    checks: tuple[Check, ...] = ()
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Alert:
    type: str = "webhook"
    url: str = ""
    trigger: str = "on_failure"
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ColumnContract:
    name: str
    type: str = ""
    checks: tuple[str | dict, ...] = ()


@dataclass(frozen=True)
class Sla:
    freshness: str = ""
    completeness: str = ""
    availability: str = ""


@dataclass(frozen=True)
class Contract:
    name: str
    owner: str = ""
    version: str = "1.0"
    source: str | Source = ""
    table: str = ""
    sla: Sla = Sla()
    columns: tuple[ColumnContract, ...] = ()
    on_violation: str = "warn"


@dataclass(frozen=True)
class Config:
    version: str = "1.0"
    sources: dict[str, Source] = field(default_factory=dict)
    suites: tuple[Suite, ...] = ()
    contracts: tuple[Contract, ...] = ()
    alerts: tuple[Alert, ...] = ()


@dataclass(frozen=True)
class CheckResult:
    check: Check
    status: Status
    severity: Severity = Severity.CRITICAL
    observed: str = ""
    expected: str = ""
    row_count: int | None = None
    failing_rows: int | None = None
    sample: tuple[str, ...] = ()
    metrics: dict[str, float] = field(default_factory=dict)
    table: str = ""
    duration_ms: int = 0

    def downgraded(self) -> CheckResult:
        """A failure of a mere warning or info check is a warning."""
        if self.status is Status.FAIL and self.severity in (Severity.INFO, Severity.WARNING):
            return replace(self, status=Status.WARN)
        return self

    def row(self) -> dict[str, Any]:
        return {
            "check_name": self.check.name, "check_type": self.check.type, "column_name": self.check.column,
            "status": str(self.status), "severity": str(self.severity), "observed": self.observed, "expected": self.expected,
            "row_count": self.row_count, "failing_rows": self.failing_rows, "sample": list(self.sample),
            "source_table": self.table, "duration_ms": self.duration_ms,
        }


RESULT_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in (
        ("check_name", T.StringType()), ("check_type", T.StringType()), ("column_name", T.StringType()), ("status", T.StringType()),
        ("severity", T.StringType()), ("observed", T.StringType()), ("expected", T.StringType()), ("row_count", T.LongType()),
        ("failing_rows", T.LongType()), ("sample", T.ArrayType(T.StringType())), ("source_table", T.StringType()), ("duration_ms", T.LongType()),
    )]
)


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class SuiteResult:
    suite: str
    results: tuple[CheckResult, ...]
    started_at: datetime = field(default_factory=utc_now)
    duration_ms: int = 0

    def count(self, *statuses: Status) -> int:
        return sum(r.status in statuses for r in self.results)

    @property
    def status(self) -> Status:
        return Status.FAIL if self.count(Status.FAIL, Status.ERROR) else Status.PASS

    @property
    def quality_score(self) -> float:
        """Weight of passed and warned checks in the weight of all, in per cent; skips count against."""
        total = sum(WEIGHTS[r.severity] for r in self.results)
        good = sum(WEIGHTS[r.severity] for r in self.results if r.status in (Status.PASS, Status.WARN))
        return round(100 * good / total, 1) if total else 100.0

    def summary(self) -> dict[str, Any]:
        return {
            "suite": self.suite, "status": str(self.status), "quality_score": self.quality_score, "total": len(self.results),
            "passed": self.count(Status.PASS), "failed": self.count(Status.FAIL), "warned": self.count(Status.WARN),
            "errored": self.count(Status.ERROR), "skipped": self.count(Status.SKIP), "duration_ms": self.duration_ms,
            "started_at": self.started_at.isoformat(),
        }

    def to_json(self) -> str:
        return json.dumps(self.summary() | {"checks": [r.row() for r in self.results]}, default=str, indent=2)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The results as a DataFrame, in the order of the checks."""
        names = RESULT_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r.row()[n] for n in names) for r in self.results], RESULT_SCHEMA)
