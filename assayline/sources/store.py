"""Results and metric history as Parquet tables.

``runs`` and ``check_results`` are partitioned by suite, and so is ``metrics``, so that a
check's history is read from its own suite's files. Rows carry the run's start to the
microsecond and its place within the run. Every save adds a small file a table;
``compact`` makes one of a suite's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RESULT_SCHEMA, SuiteResult
from ..operators.checks import history_key

_RUNS = "run_id string, suite_name string, status string, total int, passed int, failed int, warned int, errored int, skipped int, quality_score double, duration_ms long, started_at timestamp_ntz"
_METRICS = "run_id string, suite_name string, check_name string, metric_name string, value double, recorded_at timestamp_ntz"
_RESULTS = "run_id string, suite_name string, place int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_SCHEMA.fields)
TABLES = {"runs": _RUNS, "check_results": _RESULTS, "metrics": _METRICS}


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table of the store, empty before the first run."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, TABLES[name]).coalesce(1).write.mode("append").partitionBy("suite_name").parquet(f"{self.path}/{name}")

    def save(self, result: SuiteResult) -> str:
        return self.save_all([result])[0]

    def save_all(self, results: list[SuiteResult]) -> list[str]:
        """Several runs in one file a table and suite; their ids, in order."""
        ids, details, metrics, runs = [uuid.uuid4().hex for _ in results], [], [], []
        for run, result in zip(ids, results, strict=True):
            s = result.summary()
            details += [(run, result.suite, k, *[r.row()[n] for n in RESULT_SCHEMA.fieldNames()]) for k, r in enumerate(result.results)]
            for r in result.results:
                key = history_key(r.check)[0] if r.check.type in ("anomaly", "row_count_change") else r.check.name
                metrics += [(run, result.suite, key, name, float(value), result.started_at) for name, value in r.metrics.items() if value is not None]
            runs.append((run, result.suite, s["status"], s["total"], s["passed"], s["failed"], s["warned"], s["errored"], s["skipped"], float(s["quality_score"]), s["duration_ms"], result.started_at))
        self._append("check_results", details)
        self._append("metrics", metrics)
        # The run comes last: what it refers to is there when it is seen.
        self._append("runs", runs)
        return ids

    def compact(self) -> None:
        """Rewrites each table with one file a suite. No run may be saved meanwhile: the new
        files stand beside the old ones until all are written, and then take their place."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in TABLES:
            old, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in (name, f"{name}-compacted"))
            files = old.getFileSystem(conf)
            if files.exists(old):
                self.table(name).repartition("suite_name").write.mode("overwrite").partitionBy("suite_name").parquet(f"{self.path}/{name}-compacted")
                files.delete(old, True)
                files.rename(new, old)

    def history(self, suite: str, check: str, metric: str, limit: int = 30) -> list[float]:
        """The latest values of a check's metric, newest first."""
        found = self.table("metrics").filter((F.col("suite_name") == suite) & (F.col("check_name") == check) & (F.col("metric_name") == metric))
        return [r["value"] for r in found.orderBy(F.desc("recorded_at"), F.desc("run_id")).select("value").limit(limit).collect()]

    def runs(self, suite: str | None = None, limit: int = 20) -> DataFrame:
        found = self.table("runs")
        return (found.filter(F.col("suite_name") == suite) if suite else found).orderBy(F.desc("started_at"), "run_id").limit(limit)

    def details(self, run_id: str) -> DataFrame:
        return self.table("check_results").filter(F.col("run_id") == run_id).orderBy("place")

    def series(self, suite: str, check: str, metric: str) -> DataFrame:
        """All values of a metric in order of time."""
        found = self.table("metrics").filter((F.col("suite_name") == suite) & (F.col("check_name") == check) & (F.col("metric_name") == metric))
        return found.select("recorded_at", "value").orderBy("recorded_at")
