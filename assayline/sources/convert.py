"""Other tools' notations: SodaCL in, dbt tests out.

A SodaCL check is read into its parts (metric, columns, comparison, bounds, options) and
then translated by its metric; what no translation takes is listed as a comment.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..functions.scalars import seconds_of
from ..model import Check, Config

_COMPARISONS = ("<=", ">=", "!=", "<>", "=", "<", ">")


@dataclass(frozen=True)
class Expression:
    """``metric(columns) comparison bounds``, e.g. ``missing_percent(a) < 5 %``."""

    metric: str
    columns: tuple[str, ...] = ()
    comparison: str = ""
    bounds: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def read(cls, text: str, options: Any = None) -> Expression:
        head, comparison, bounds = text.strip(), "", ()
        if " between " in head:
            head, _, rest = head.partition(" between ")
            comparison, bounds = "between", tuple(x.strip() for x in rest.split(" and "))
        else:
            at = min((k for k, c in enumerate(head) if c in "<>=!"), default=len(head))
            sign = next((s for s in _COMPARISONS if head.startswith(s, at)), "")
            if sign:
                comparison, bounds, head = sign, (head[at + len(sign) :].strip(),), head[:at]
        metric, _, inside = head.strip().partition("(")
        columns = tuple(c.strip() for c in inside.rstrip(")").split(",") if c.strip())
        return cls(metric.strip(), columns, comparison, bounds, options if isinstance(options, dict) else {})

    def numbers(self) -> list[float]:
        return [float(b.rstrip("% ")) for b in self.bounds]

    def between(self) -> tuple[float | None, float | None]:
        """The least and the most of whole numbers for which the comparison holds."""
        n = self.numbers()
        return {
            "=": lambda: (n[0], n[0]), ">": lambda: (n[0] + 1, None), ">=": lambda: (n[0], None),
            "<": lambda: (None, n[0] - 1), "<=": lambda: (None, n[0]), "between": lambda: (n[0], n[1]),
        }[self.comparison]()

    def none_allowed(self) -> bool:
        """Whether the comparison lets a count be 0 only."""
        return self.comparison in ("=", "<", "<=") and self.between()[1] == 0


Made = list[dict[str, Any]] | None


def _limits(low: float | None, high: float | None) -> dict[str, Any]:
    plain = lambda x: int(x) if x == int(x) else x
    return {k: plain(v) for k, v in (("min", low), ("max", high)) if v is not None}


def _missing(e: Expression) -> Made:
    return [{"not_null": c} for c in e.columns] if e.none_allowed() else None


def _missing_share(e: Expression) -> Made:
    if e.comparison not in ("<", "<=") or len(e.columns) != 1:
        return None
    return [{"completeness": {"column": e.columns[0], "min": round(1 - e.numbers()[0] / 100, 4)}}]


def _duplicates(e: Expression) -> Made:
    if not e.none_allowed() or not e.columns:
        return None
    return [{"unique": e.columns[0]}] if len(e.columns) == 1 else [{"unique_combination": list(e.columns)}]


def _rows(e: Expression) -> Made:
    low, high = e.between()
    return [{"row_count": _limits(low, high)}]


def _extreme(e: Expression) -> Made:
    """A bound on the least or largest value, which no value may then pass."""
    side, signs = {"min": ("min", (">=", "=")), "max": ("max", ("<=", "="))}[e.metric]
    return [{"range": {"column": e.columns[0], side: e.numbers()[0]}}] if e.comparison in signs and len(e.columns) == 1 else None


def _invalid(e: Expression) -> Made:
    if not e.none_allowed() or len(e.columns) != 1:
        return None
    said = {str(k).replace("_", " "): v for k, v in e.options.items()}
    column = {"column": e.columns[0]}
    if said.get("valid values"):
        return [{"accepted_values": column | {"values": list(said["valid values"])}}]
    if said.get("valid regex"):
        return [{"regex": column | {"pattern": said["valid regex"]}}]
    if said.get("valid format") == "email":
        return [{"email_validation": e.columns[0]}]
    if "valid min" in said or "valid max" in said:
        return [{"range": column | _limits(said.get("valid min"), said.get("valid max"))}]
    return None


def _fresh(e: Expression) -> Made:
    if e.comparison not in ("<", "<=") or len(e.columns) != 1:
        return None
    age = e.bounds[0].lower().replace(" ", "")
    seconds_of(age)
    return [{"freshness": {"column": e.columns[0], "max_age": age}}]


def _schema(e: Expression) -> Made:
    """Columns that have to be there are asked to be filled, and listed types to hold."""
    rules: dict[str, Any] = {}
    for level in ("warn", "fail"):
        rules |= e.options.get(level) or {} if isinstance(e.options.get(level), dict) else {}
    if not rules or not set(rules) <= {"when required column missing", "when wrong column type"}:
        return None
    out = [{"not_null": c} for c in rules.get("when required column missing") or ()]
    return out + [{"type": {"column": c, "expected": t}} for c, t in (rules.get("when wrong column type") or {}).items()]


SODA_METRICS: dict[str, Callable[[Expression], Made]] = {
    "missing_count": _missing, "missing_percent": _missing_share, "duplicate_count": _duplicates, "row_count": _rows,
    "min": _extreme, "max": _extreme, "invalid_count": _invalid, "freshness": _fresh, "schema": _schema,
}


def _translated(raw: Any) -> Made:
    try:
        text, options = (raw, None) if isinstance(raw, str) else next(iter(raw.items()))
        e = Expression.read(str(text), options)
        return SODA_METRICS[e.metric](e)
    except (KeyError, ValueError, IndexError, AttributeError, StopIteration):
        return None


def from_soda(text: str, source_type: str = "spark") -> str:
    """A configuration for a SodaCL file: one table's checks at the top, or a suite for each
    of several tables. What has no counterpart stands below in comments."""
    suites, others = [], []
    for key, listed in (yaml.safe_load(text) or {}).items():
        words = str(key).split()
        if words[:2] != ["checks", "for"] or len(words) < 3 or not isinstance(listed, list):
            continue
        made = [(raw, _translated(raw)) for raw in listed]
        suites.append({"name": words[2], "source": {"type": source_type, "table": words[2]}, "checks": [c for _, checks in made for c in checks or ()]})
        others += [f"# {words[2]}: {raw if isinstance(raw, str) else next(iter(raw), raw)}\n" for raw, checks in made if checks is None]
    body = {k: v for k, v in suites[0].items() if k != "name"} if len(suites) == 1 else {"suites": suites}
    out = yaml.safe_dump(body, sort_keys=False, allow_unicode=True)
    return out + ("\n# Not translated:\n" + "".join(others) if others else "")


def _share_test(check: Check) -> dict[str, Any]:
    from ..functions.scalars import fraction_of

    return {"dbt_utils.not_null_proportion": {"at_least": fraction_of(check.params.get("min", 0.95))}}


#: A column's test for a check, by kind; dbt's and dbt_utils' names are fixed.
DBT_COLUMN_TESTS: dict[str, Callable[[Check], Any]] = {
    "not_null": lambda c: "not_null",
    "unique": lambda c: "unique",
    "completeness": _share_test,
    "accepted_values": lambda c: {"accepted_values": {"values": list(c.params.get("values") or ())}},
    "range": lambda c: {"dbt_utils.accepted_range": {f"{k}_value": c.params[k] for k in ("min", "max") if c.params.get(k) is not None}},
    "referential_integrity": lambda c: {"relationships": {"to": f"ref('{c.params['reference_table']}')", "field": c.params["reference_column"]}},
}


def to_dbt(config: Config) -> str:
    """A dbt schema file with a model for every suite; checks that dbt has no like of are
    comments."""
    models, others = [], []
    for suite in config.suites:
        columns: dict[str, list[Any]] = {}
        together = []
        for check in suite.checks:
            if check.type == "unique_combination":
                together.append({"dbt_utils.unique_combination_of_columns": {"combination_of_columns": list(check.columns)}})
            elif check.type in DBT_COLUMN_TESTS and (check.column or check.columns) and not (check.type == "range" and not check.params):
                for name in check.columns or (check.column,):
                    columns.setdefault(name, []).append(DBT_COLUMN_TESTS[check.type](check))
            else:
                others.append(f"# {suite.name}: {check.name}\n")
        model: dict[str, Any] = {"name": suite.name}
        if together:
            model["tests"] = together
        if columns:
            model["columns"] = [{"name": n, "tests": t} for n, t in columns.items()]
        models.append(model)
    out = yaml.safe_dump({"version": 2, "models": models}, sort_keys=False, allow_unicode=True)
    return out + ("\n# Without a dbt test:\n" + "".join(others) if others else "")
