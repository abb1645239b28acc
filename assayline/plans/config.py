"""Configuration files: YAML to the model, and a structural check of them."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path
from typing import Any

import yaml

from ..model import Alert, Check, ColumnContract, Config, Contract, Severity, Sla, Source, Suite
from ..operators.checks import KINDS


def parse_check(raw: Any) -> Check:
    """``"not_null: a"``, ``{not_null: [a, b]}``, ``{range: {column: a, min: 0}}``, and a
    ``severity`` inside the parameters or beside the check."""
    if isinstance(raw, str):
        kind, _, rest = raw.partition(":")
        return Check(kind.strip(), rest.strip() or None)
    if not isinstance(raw, dict) or not raw:
        raise ValueError(f"Invalid check {raw!r}")
    beside = raw.get("severity") if len(raw) > 1 else None
    kinds = [k for k in raw if not (k == "severity" and len(raw) > 1)]
    if len(kinds) != 1:
        raise ValueError(f"A check has one type, not {kinds}")
    kind, value = kinds[0], raw[kinds[0]]
    if isinstance(value, list):
        names = tuple(str(v) for v in value)
        single = len(names) == 1 and kind != "unique_combination"
        return Check(kind, names[0] if single else None, () if single else names, severity=beside)
    if isinstance(value, dict):
        columns = tuple(value.get("columns") or ())
        column = value.get("column") or (columns[0] if len(columns) == 1 and kind != "unique_combination" else None)
        params = {k: v for k, v in value.items() if k not in ("column", "columns", "severity")}
        return Check(kind, column, columns if column is None else (), params, value.get("severity", beside))
    if isinstance(value, str):
        return Check(kind, params={"query": value}, severity=beside) if kind == "custom_sql" else Check(kind, value, severity=beside)
    return Check(kind, params={} if value is None else {"value": value}, severity=beside)


def _source(raw: Any, known: dict[str, Source], where: str) -> Source:
    if isinstance(raw, str):
        if raw not in known:
            raise ValueError(f"Unknown source reference '{raw}' in {where}. Available sources: {', '.join(known) or 'none defined'}")
        return known[raw]
    raw = dict(raw or {})
    given = {k: raw.pop(k) for k in ("type", "connection", "table", "options") if k in raw}
    raw.pop("conn_id", None)  # for schedulers
    if raw:
        raise ValueError(f"Unknown keys in a source: {', '.join(raw)}")
    return Source(**given)


def parse_contract(raw: dict[str, Any]) -> Contract:
    schema = raw.get("schema") or raw.get("schema_def") or {}
    columns = []
    for c in schema.get("columns") or []:
        columns.append(ColumnContract(c["name"], str(c.get("type", "")), tuple(c.get("checks") or ())))
    source = raw.get("source", "")
    sla = {k: str(v) for k, v in (raw.get("sla") or {}).items()}
    action = raw.get("on_violation", "warn")
    if action not in ("block", "warn", "quarantine"):
        raise ValueError(f"on_violation is block, warn or quarantine, not {action!r}")
    return Contract(
        raw["name"], raw.get("owner", ""), str(raw.get("version", "1.0")), _source(source, {}, "") if isinstance(source, dict) else source,
        raw.get("table", ""), Sla(**sla), tuple(columns), action,
    )


def from_dict(raw: dict[str, Any], name: str = "config") -> Config:
    """A configuration with its suites, contracts and alerts.

    Either ``source`` and ``checks`` stand at the top, making one suite called ``name``,
    or ``suites`` lists them. Schedules, connection ids and descriptions are for other
    tools, and passed over.
    """
    known = {k: _source(v, {}, f"source '{k}'") for k, v in (raw.get("sources") or {}).items()}
    suites = []
    listed = [{"name": name, **{k: raw[k] for k in ("source", "checks", "tags", "table") if k in raw}}] if "checks" in raw else raw.get("suites") or []
    for s in listed:
        source = _source(s.get("source"), known, f"suite '{s.get('name', '?')}'")
        if "table" in s:
            source = replace(source, table=s["table"])
        suites.append(Suite(s["name"], source, tuple(parse_check(c) for c in s.get("checks") or []), tuple(s.get("tags") or ())))
    alerts = tuple(Alert(**a) for a in raw.get("alerts") or [])
    return Config(str(raw.get("version", "1.0")), known, tuple(suites), tuple(parse_contract(c) for c in raw.get("contracts") or []), alerts)


def load(path: str | Path) -> Config:
    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if raw is None:
        raise ValueError(f"Empty configuration file: {path}")
    if not isinstance(raw, dict):
        raise ValueError(f"Not a configuration: {path}")
    return from_dict(raw, Path(path).stem)


#: What a check's parameters may be; a type that isn't listed takes any.
PARAMETERS = {
    "not_null": set(), "unique": set(), "unique_combination": set(), "email_validation": set(),
    "completeness": {"min"}, "accepted_values": {"values"}, "range": {"min", "max"}, "regex": {"pattern"}, "type": {"expected", "value"},
    "freshness": {"max_age"}, "latency": {"source_column", "target_column", "max_latency"}, "row_count": {"min", "max"},
    "referential_integrity": {"reference_table", "reference_column"}, "custom_sql": {"query", "name"},
    "anomaly": {"metric", "method", "sensitivity", "threshold"}, "row_count_change": {"max_decrease", "max_increase"},
}


def problems(config: Config) -> list[str]:
    """What is wrong with a configuration that can be said without its data."""
    out = []
    for suite in config.suites:
        for check in suite.checks:
            where = f"{suite.name}: {check.name}"
            if check.type not in KINDS:
                out.append(f"{where}: unknown check type")
            elif extra := set(check.params) - PARAMETERS.get(check.type, set(check.params)):
                out.append(f"{where}: unknown parameter {', '.join(sorted(extra))}")
            if check.severity is not None and check.severity not in set(Severity):
                out.append(f"{where}: unknown severity {check.severity}")
            if check.type == "anomaly" and "metric" not in check.params:
                out.append(f"{where}: 'metric' parameter is required")
            if check.type == "accepted_values" and not check.params.get("values"):
                out.append(f"{where}: no accepted values")
    names = [s.name for s in config.suites]
    out += [f"suite name {n} repeats" for n in sorted({n for n in names if names.count(n) > 1})]
    return out


def dump(checks: list[dict[str, Any]], source_type: str, table: str) -> str:
    """A configuration file with the given checks."""
    return yaml.safe_dump({"source": {"type": source_type, "table": table}, "checks": checks}, sort_keys=False, allow_unicode=True)
