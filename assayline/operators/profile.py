"""Profiles of tables, and checks that a profile suggests."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_numeric
from .checks import quoted

#: Distinct values up to which a column's commonest are listed, and how many are.
LISTED_BELOW, TOP = 50, 10
#: Distinct values up to which a column's list of accepted values is suggested.
LISTED = 20
#: Values that are sorted in one task to find the middle ones.
FEW = 200_000


@dataclass
class ColumnProfile:
    name: str
    type: str
    total: int = 0
    nulls: int = 0
    distinct: int = 0
    min: Any = None
    max: Any = None
    mean: float | None = None
    stddev: float | None = None
    median: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    mean_length: float | None = None
    top_values: list[dict[str, Any]] = field(default_factory=list)
    numeric: bool = False

    @property
    def null_pct(self) -> float:
        return round(100 * self.nulls / self.total, 2) if self.total else 0.0

    @property
    def distinct_pct(self) -> float:
        return round(100 * self.distinct / self.total, 2) if self.total else 0.0


@dataclass
class TableProfile:
    table: str
    row_count: int
    columns: list[ColumnProfile]


def exact_medians(df: DataFrame, names: list[str], few: int = FEW) -> dict[str, float | None]:
    """The exact median of each numeric column, whatever the number of rows.

    Each round is one pass for all columns: it counts the values below, within and at the
    ends of an interval that holds the middle ones and sketches those within, so that the
    next interval is some thirty times smaller; no values are shuffled. At most ``few``
    values are sorted in one task at the end. A column without values has none.
    """
    value = {n: quoted(n).cast("double") for n in names}
    left: dict[str, tuple[float, float]] = {n: (-math.inf, math.inf) for n in names}
    middle: dict[str, list[float | None]] = {n: [None, None] for n in names}
    inside = lambda n: F.when(value[n].between(*left[n]), value[n])
    while left:
        aggs = []
        for k, (n, (low, high)) in enumerate(left.items()):
            x = inside(n)
            aggs += [F.count(value[n]).alias(f"n{k}"), F.count_if(value[n] < low).alias(f"b{k}"), F.count(x).alias(f"m{k}"), F.count_if(x == low).alias(f"l{k}"), F.count_if(x == high).alias(f"h{k}")]
            aggs.append(F.percentile_approx(x, [j / 100 for j in range(101)], 10_000).alias(f"g{k}"))
        row, sorted_next, following = df.agg(*aggs).first(), {}, {}
        for k, (n, (low, high)) in enumerate(left.items()):
            total, before, within, at_low, at_high, grid = (row[f"{c}{k}"] for c in "nbmlhg")
            if not total:
                continue
            ranks = [(total - 1) // 2 - before, total // 2 - before]
            for j, r in enumerate(ranks):
                if middle[n][j] is None and (r < at_low or r >= within - at_high):
                    middle[n][j] = low if r < at_low else high
            open_ = [r for j, r in enumerate(ranks) if middle[n][j] is None]
            if open_ and within <= few:
                sorted_next[n] = ranks
            elif open_:
                ends = grid[max(100 * min(open_) // within - 1, 0)], grid[min(-(-100 * max(open_) // within) + 1, 100)]
                # What is neither end lies between them.
                following[n] = ends if ends != (low, high) else (math.nextafter(low, math.inf), math.nextafter(high, -math.inf))
        if sorted_next:
            ranked = {n: F.sort_array(F.collect_list(inside(n))) for n in sorted_next}
            picked = [F.struct(*[F.get(ranked[n], F.lit(r)).alias(f"r{j}") for j, r in enumerate(ranks)]).alias(f"p{k}") for k, (n, ranks) in enumerate(sorted_next.items())]
            found = df.agg(*picked).first()
            for k, n in enumerate(sorted_next):
                middle[n] = [found[f"p{k}"][j] if m is None else m for j, m in enumerate(middle[n])]
        left = following
    return {n: None if a is None else (a + b) / 2 for n, (a, b) in middle.items()}


def numeric_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: count, nulls, min, max, mean, stddev (of the sample) and the exact median."""
    c = quoted(name)
    median = exact_medians(df, [name])[name]
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c.isNull()).alias("nulls"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.avg(c.cast("double")).alias("mean"), F.stddev_samp(c.cast("double")).alias("stddev"), F.lit(median).cast("double").alias("median"),
    )


def string_stats(df: DataFrame, name: str) -> DataFrame:
    """One row: count, nulls and the least, most and mean length in characters."""
    c = quoted(name)
    size = F.char_length(c).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(c.isNull()).alias("nulls"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length"))


def top_values(df: DataFrame, name: str, n: int = TOP) -> DataFrame:
    """The commonest set values with their counts; ties come in the order of the values."""
    return df.filter(quoted(name).isNotNull()).groupBy(quoted(name).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(k, value, n): how often each set value of each column stands there, by the column's
    place in ``names`` and the value's text. One pass over the table counts on the map side."""
    kinds = {f.name: f.dataType for f in df.select(*[F.col(f"`{n}`") for n in names]).schema.fields}

    def text(n: str) -> Column:
        c = F.col(f"`{n}`")
        if isinstance(kinds[n], T.BinaryType):
            return F.hex(c)
        # Adding nothing makes one zero of the two that floating point has.
        return (c + F.lit(0.0).cast(kinds[n]) if isinstance(kinds[n], T.FractionalType) else c).cast("string")

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), text(n).alias("value")) for k, n in enumerate(names)]))
    return df.select(each.alias("e")).filter("e.value IS NOT NULL").groupBy("e.k", "e.value").agg(F.count(F.lit(1)).alias("n"))


def _typed(text: str, kind: T.DataType) -> Any:
    """A value from its text, for what a profile shows."""
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(text)
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, T.BooleanType):
        return text == "true"
    if isinstance(kind, T.DateType):
        return date.fromisoformat(text)
    return datetime.fromisoformat(text) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else text


def profile(df: DataFrame, table: str = "", columns: list[str] | None = None, sample_percent: float | None = None, seed: int = 0) -> TableProfile:
    """Profiles columns of a table, or of a random sample of ``sample_percent`` of its rows.

    Counts, extremes, means and lengths come from one job over the table, distinct counts
    and commonest values of all columns from a second, medians from a third (and more for
    large tables). Ties among the commonest come in the order of the values' text. Mean,
    deviation, median and mean length are rounded to four places.
    """
    if sample_percent is not None and sample_percent < 100:
        df = df.sample(False, max(sample_percent, 0.0) / 100, seed)
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"c{k}"))
        if is_numeric(f.dataType):
            d = c.cast("double")
            aggs += [F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}"), F.avg(d).alias(f"mean{k}"), F.stddev_samp(d).alias(f"sd{k}")]
        elif isinstance(f.dataType, T.StringType):
            size = F.char_length(c)
            aggs += [F.min(size).alias(f"lo{k}"), F.max(size).alias(f"hi{k}"), F.avg(size).alias(f"mean{k}")]
    row = df.agg(*aggs).first()
    n, out = row["n"], []
    medians = exact_medians(df, [f"`{f.name}`" if "." in f.name else f.name for f in fields if is_numeric(f.dataType)]) if n else {}
    rounded = lambda x: None if x is None else round(x, 4)
    for k, f in enumerate(fields):
        p = ColumnProfile(f.name, f.dataType.simpleString(), n, n - row[f"c{k}"], numeric=is_numeric(f.dataType))
        if p.numeric:
            p.min, p.max, p.mean, p.stddev, p.median = row[f"lo{k}"], row[f"hi{k}"], rounded(row[f"mean{k}"]), rounded(row[f"sd{k}"]), rounded(medians.get(f.name))
        elif isinstance(f.dataType, T.StringType):
            p.min_length, p.max_length, p.mean_length = row[f"lo{k}"], row[f"hi{k}"], rounded(row[f"mean{k}"])
        out.append(p)
    countable = [k for k, f in enumerate(fields) if not isinstance(f.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType))]
    if n and countable:
        counts = value_counts(df, [fields[k].name for k in countable])
        distinct = counts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", F.lit(None).cast("string").alias("value"), "n")
        commonest = counts.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= LISTED).select("k", "value", "n")
        shown: dict[int, list[tuple[int, str]]] = {}
        for r in distinct.unionByName(commonest).collect():
            if r["value"] is None:
                out[countable[r["k"]]].distinct = r["n"]
            else:
                shown.setdefault(countable[r["k"]], []).append((-r["n"], r["value"]))
        for k, found in shown.items():
            p = out[k]
            if p.distinct <= LISTED_BELOW:
                # A list that becomes a suggestion has to be whole.
                most = max(TOP, p.distinct) if p.distinct <= LISTED else TOP
                p.top_values = [{"value": _typed(v, fields[k].dataType), "count": -c} for c, v in sorted(found)[:most]]
    for k, f in enumerate(fields):
        if n and isinstance(f.dataType, (T.ArrayType, T.StructType)) and not _has_map(f.dataType):
            c = F.col(f"`{f.name}`")
            out[k].distinct = df.filter(c.isNotNull()).groupBy(c).agg(F.lit(1)).count()
    return TableProfile(table, n, out)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def suggest(profiled: TableProfile) -> list[dict[str, Any]]:
    """Checks, in the configuration's notation, that the profiled table passes."""
    filled = [c.name for c in profiled.columns if c.null_pct == 0]
    out: list[dict[str, Any]] = [{"not_null": filled}] if filled else []
    out += [{"unique": c.name} for c in profiled.columns if c.distinct_pct == 100 and c.total > 1]
    out.append({"row_count": {"min": max(1, profiled.row_count // 2)}})
    for c in profiled.columns:
        if c.numeric and c.min is not None:
            low, high = float(c.min), float(c.max)
            margin = 0.1 * ((high - low) or abs(low))
            out.append({"range": {"column": c.name, "min": round(low - margin, 2), "max": round(high + margin, 2)}})
        elif not c.numeric and 1 <= c.distinct <= LISTED and c.top_values and _nameable(c.type):
            out.append({"accepted_values": {"column": c.name, "values": [str(v["value"]) for v in c.top_values]}})
    return out


def _nameable(kind: str) -> bool:
    """Types whose values a list in a configuration can name."""
    return kind in ("string", "boolean", "date")
