"""Anomaly detectors over a history of values, in Python and as DataFrame expressions."""

from __future__ import annotations

import statistics
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points that a history must have.
LEAST_POINTS = 5
#: Deviations, or interquartile ranges, beyond which a value is anomalous.
SENSITIVITY = {"low": 4.0, "medium": 3.0, "high": 2.0}
#: Makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 1.4826


@dataclass(frozen=True)
class Anomaly:
    is_anomaly: bool
    score: float
    observed: float
    lower: float
    upper: float
    method: str
    explanation: str = ""


def _around(method: str, value: float, centre: float, spread: float, limit: float) -> Anomaly:
    """Anomalous beyond ``limit`` spreads from the centre; without spread, off the centre."""
    away = abs(value - centre)
    if not spread:
        odd = value != centre
        return Anomaly(odd, float(odd), value, round(centre, 4), round(centre, 4), method, "history is constant")
    z = away / spread
    return Anomaly(z > limit, round(min(z / limit, 1.0), 4), value, round(centre - limit * spread, 4), round(centre + limit * spread, 4), method, f"{z:.2f} spreads from {centre:.4g}")


def zscore(past: list[float], value: float, limit: float = 3.0) -> Anomaly:
    return _around("zscore", value, statistics.fmean(past), statistics.stdev(past), limit)


def mad(past: list[float], value: float, limit: float = 3.0) -> Anomaly:
    middle = statistics.median(past)
    return _around("mad", value, middle, MAD_SCALE * statistics.median(abs(x - middle) for x in past), limit)


def iqr(past: list[float], value: float, limit: float = 3.0) -> Anomaly:
    """Fences ``limit`` interquartile ranges outside the exclusive quartiles."""
    low, _, high = statistics.quantiles(past, n=4)
    reach = limit * (high - low)
    if not reach:
        odd = not low <= value <= high
        return Anomaly(odd, float(odd), value, round(low, 4), round(high, 4), "iqr", "quartiles are equal")
    outside = max(low - reach - value, value - high - reach, 0.0)
    return Anomaly(outside > 0, round(min(outside / reach, 1.0), 4), value, round(low - reach, 4), round(high + reach, 4), "iqr", f"{outside:.4g} outside the fences")


DETECTORS = {"zscore": zscore, "mad": mad, "iqr": iqr}


def detect(method: str, past: list[float], value: float, sensitivity: str = "medium", threshold: float | None = None) -> Anomaly:
    """Dispatches by name; a threshold goes before the sensitivity. Fewer points than
    needed, or an unknown method without a threshold, find nothing."""
    if len(past) < LEAST_POINTS:
        return Anomaly(False, 0.0, value, 0.0, 0.0, method, f"{len(past)} of {LEAST_POINTS} points")
    if threshold is not None:
        return DETECTORS.get(method, mad)(past, value, float(threshold))
    if method not in DETECTORS:
        return Anomaly(False, 0.0, value, 0.0, 0.0, method, f"unknown method {method!r}")
    return DETECTORS[method](past, value, SENSITIVITY.get(sensitivity, 3.0))


def series_bounds(series: DataFrame, keys: list[str], value: str, method: str, limit: float) -> DataFrame:
    """For every key the bounds that a detector sets around the key's history.

    Returns the keys, n, lower and upper: null with fewer than ``LEAST_POINTS`` points.
    Aggregations pre-combine on the map side; mad takes a second pass for the deviations,
    and the exclusive quartiles of iqr come from ranks within a key.
    """
    points = series.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    enough = lambda c: F.when(F.col("n") >= LEAST_POINTS, c)
    if method == "zscore":
        stats = points.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("centre"), F.stddev_samp("x").alias("spread"))
    elif method == "mad":
        middle = points.groupBy(*keys).agg(F.count("x").alias("n"), F.percentile("x", F.lit(0.5)).alias("centre"))
        joined = points.join(middle, keys) if keys else points.crossJoin(F.broadcast(middle))
        off = joined.groupBy(*keys).agg(F.percentile(F.abs(F.col("x") - F.col("centre")), F.lit(0.5)).alias("off"), F.first("n").alias("n"), F.first("centre").alias("centre"))
        stats = off.withColumn("spread", MAD_SCALE * F.col("off"))
    elif method == "iqr":
        ranked = points.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("x"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
        for k in (1, 3):
            j = F.greatest(F.lit(1), F.least(F.floor(F.lit(k) * (F.col("n") + 1) / 4), F.col("n") - 1))
            rest = F.lit(k) * (F.col("n") + 1) - 4 * j
            part = F.when(F.col("r") == j, F.col("x") * (4 - rest) / 4).when(F.col("r") == j + 1, F.col("x") * rest / 4)
            ranked = ranked.withColumn(f"q{k}", part)
        quartiles = ranked.groupBy(*keys).agg(F.first("n").alias("n"), F.sum("q1").alias("q1"), F.sum("q3").alias("q3"))
        reach = limit * (F.col("q3") - F.col("q1"))
        return quartiles.select(*keys, "n", enough(F.col("q1") - reach).alias("lower"), enough(F.col("q3") + reach).alias("upper"))
    else:
        raise ValueError(f"Unknown method {method!r}")
    return stats.select(*keys, "n", enough(F.col("centre") - limit * F.col("spread")).alias("lower"), enough(F.col("centre") + limit * F.col("spread")).alias("upper"))
