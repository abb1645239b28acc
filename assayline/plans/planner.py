"""From checks to jobs.

All metrics without DISTINCT of a table's checks make one aggregation: equal metrics are
computed once, by their expression, and every check keeps its own names for them. Checks
that need distinct values, joins or queries have a job of their own, because folding
distinct aggregates into the one job expands every row for each of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from ..model import Check
from ..operators.checks import KINDS, CheckError, Context, Kind

#: Aggregates of one job; more are dealt over several, as generated code has its limits.
AT_ONCE = 100


@dataclass
class Plan:
    """``columns``: the aggregates by alias. ``names``: for each fused check (by its place)
    the alias of each of its metrics. ``errors``: checks that can't be planned."""

    columns: dict[str, Column] = field(default_factory=dict)
    names: dict[int, dict[str, str]] = field(default_factory=dict)
    alone: list[int] = field(default_factory=list)
    errors: dict[int, str] = field(default_factory=dict)

    def jobs(self) -> list[dict[str, Column]]:
        items = list(self.columns.items())
        return [dict(items[k : k + AT_ONCE]) for k in range(0, len(items), AT_ONCE)]


def expanded(checks: tuple[Check, ...]) -> list[Check]:
    """not_null, completeness and unique over several columns as one check for each."""
    out = []
    for check in checks:
        several = check.type in ("not_null", "completeness", "unique") and len(check.columns) > 1
        out += [replace(check, column=c, columns=()) for c in check.columns] if several else [check]
    return out


def kind_of(check: Check) -> Kind:
    if check.type not in KINDS:
        raise CheckError(f"Unknown check type '{check.type}'; known: {', '.join(sorted(KINDS))}")
    return KINDS[check.type]


def _unresolved(df: DataFrame, planned: dict[int, dict[str, Column]]) -> dict[int, str]:
    """What the analyser says against any check's metrics, without running a job.

    All are analysed at once; only if that fails is each looked at by itself.
    """

    def analysed(metrics: list[dict[str, Column]]) -> None:
        df.agg(*[c.alias(f"{k}_{n}") for k, m in enumerate(metrics) for n, c in m.items()]).schema  # noqa: B018

    out: dict[int, str] = {}
    if planned:
        try:
            analysed(list(planned.values()))
        except Exception:
            for place, metrics in planned.items():
                try:
                    analysed([metrics])
                except Exception as e:
                    out[place] = str(e).split("\n")[0]
    return out


def plan(df: DataFrame, checks: list[Check], context: Context, fuse: bool = True) -> Plan:
    out, seen, planned = Plan(), {}, {}
    for place, check in enumerate(checks):
        try:
            kind = kind_of(check)
            if kind.shares(check):
                planned[place] = kind.fused(check, context)
            else:
                out.alone.append(place)
        except Exception as e:  # the analyser's errors come in many classes
            out.errors[place] = str(e).split("\n")[0]
    out.errors |= _unresolved(df, planned)
    for place, metrics in planned.items():
        if place in out.errors:
            continue
        names = {}
        for name, column in metrics.items():
            key = str(column._jc.toString()) if hasattr(column, "_jc") else str(column)
            alias = seen.get(key) if fuse else None
            if alias is None:
                alias = seen[key] = f"m{len(out.columns)}"
                out.columns[alias] = column
            names[name] = alias
        out.names[place] = names
    return out
