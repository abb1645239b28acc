"""Durations, intervals, percentages and the categories of types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds_of(duration: str) -> int:
    """Seconds of ``30s``, ``15m``, ``24h`` or ``7d``."""
    if found := re.fullmatch(r"(\d+)([smhd])", str(duration).strip()):
        return int(found[1]) * _UNITS[found[2]]
    raise ValueError(f"Invalid duration {duration!r}: write 30m, 24h or 7d")


def duration_text(seconds: int) -> str:
    """The two largest units, the smaller one from hours on: ``5m``, ``3h 20m``, ``2d 1h``."""
    for unit, below, lower in (("s", 60, None), ("m", 3600, None), ("h", 86400, "m"), ("d", None, "h")):
        if below is None or seconds < below:
            whole = seconds // _UNITS[unit]
            return f"{whole}{unit}" if lower is None else f"{whole}{unit} {seconds % _UNITS[unit] // _UNITS[lower]}{lower}"
    raise AssertionError


def interval_seconds(interval: str) -> int:
    """Seconds of whole numbers with units, the larger unit first: ``1h30m``, ``5m`` or ``45s``; at least one."""
    total, number, below = 0, "", _UNITS["d"]
    for c in interval.strip().lower():
        if c.isdecimal():
            number += c
            continue
        unit = _UNITS.get(c, 0)
        if not number or not 0 < unit < below:
            break
        total, number, below = total + int(number) * unit, "", unit
    else:
        if total > 0 and not number:
            return total
    raise ValueError(f"Invalid interval {interval!r}: write 30s, 5m or 1h30m")


def interval_text(seconds: int) -> str:
    hours, rest = divmod(seconds, 3600)
    minutes, rest = divmod(rest, 60)
    if hours:
        return f"{hours}h" + (f"{minutes}m" if minutes else "")
    return f"{minutes}m" + (f"{rest}s" if rest else "") if minutes else f"{rest}s"


def fraction_of(value: float | int | str) -> float:
    """0.95 from ``"95%"``, 95 or 0.95: what exceeds 1 is per cent."""
    text = str(value).strip()
    number = float(text.rstrip("%"))
    if text.endswith("%"):
        return number / 100
    return number / 100 if number > 1 else number


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one timestamp to another, with their fraction and without a time zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def epoch_seconds(moment: Column) -> Column:
    """Seconds since 1970 on the clock that a zoneless timestamp shows."""
    return seconds_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment.cast("timestamp_ntz"))


#: Names of types that hosts and users write, by category. Fixed values.
TYPE_NAMES = {
    "integer": ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "int2", "int4", "int8", "int32", "int64", "byte", "short", "long", "serial", "bigserial"),
    "float": ("float", "real", "double", "double precision", "decimal", "numeric", "float4", "float8"),
    "string": ("varchar", "char", "text", "string", "character varying", "character", "bpchar"),
    "boolean": ("boolean", "bool"),
    "date": ("date",),
    "timestamp": ("timestamp", "datetime", "timestamptz", "timestamp_ntz", "timestamp_ltz", "timestamp with time zone", "timestamp without time zone"),
    "time": ("time", "time without time zone"),
}
_CATEGORY = {name: category for category, names in TYPE_NAMES.items() for name in (category, *names)}


def type_category(name: str) -> str:
    """The category of a type's name; a name that none has is its own category."""
    bare = re.sub(r"\(.*\)", "", name).strip().lower()
    return _CATEGORY.get(bare, bare)


def column_category(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision == 38:
        return "integer"
    return type_category(kind.simpleString())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)
