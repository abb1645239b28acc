"""Results as text, JSON, CSV, HTML and webhook calls."""

from __future__ import annotations

import csv
import html
import io
import json
import urllib.error
import urllib.request
from string import Template

from ..model import Alert, Status, SuiteResult
from .resolve import expand

_COLUMNS = ("check_name", "status", "severity", "observed", "expected", "failing_rows")


def as_table(result: SuiteResult) -> str:
    rows = [_COLUMNS, *[tuple("" if (v := r.row()[c]) is None else str(v) for c in _COLUMNS) for r in result.results]]
    width = [max(len(r[k]) for r in rows) for k in range(len(_COLUMNS))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in rows]
    s = result.summary()
    return "\n".join([f"Suite {result.suite}: {s['status']}, score {s['quality_score']}, {s['passed']} of {s['total']} passed", *lines])


def as_csv(results: list[SuiteResult]) -> str:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(("suite", *_COLUMNS))
    for result in results:
        writer.writerows((result.suite, *[r.row()[c] for c in _COLUMNS]) for r in result.results)
    return out.getvalue()


def as_json(results: list[SuiteResult]) -> str:
    return json.dumps([json.loads(r.to_json()) for r in results], indent=2)


_PAGE = Template(
    """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title><style>
body { font: 15px/1.5 system-ui, sans-serif; margin: 2rem auto; max-width: 70rem; padding: 0 1rem }
table { border-collapse: collapse; width: 100% } th, td { border-bottom: 1px solid #ccc; padding: .3rem .6rem; text-align: left }
.pass { color: #17692b } .fail, .error { color: #a31515 } .warn { color: #8a5a00 } .skip { color: #666 } pre { margin: 0; white-space: pre-wrap }
</style></head><body><h1>$title</h1>$suites</body></html>
"""
)


def as_html(results: list[SuiteResult], title: str = "Data quality") -> str:
    """A page on its own; everything that comes from data or configuration is escaped."""
    e = lambda x: html.escape("" if x is None else str(x))
    parts = []
    for result in results:
        s = result.summary()
        rows = "".join(
            f"<tr><td>{e(r.check.name)}</td><td class='{r.status}'>{r.status}</td><td>{r.severity}</td><td>{e(r.observed)}</td><td>{e(r.expected)}</td><td>{e(r.failing_rows)}</td>"
            f"<td><pre>{e(chr(10).join(r.sample))}</pre></td></tr>"
            for r in result.results
        )
        parts.append(
            f"<h2>{e(result.suite)}</h2><p class='{s['status']}'>{s['status']}: score {s['quality_score']}, {s['passed']} passed, {s['failed']} failed, {s['warned']} warned, "
            f"{s['errored']} errors, {s['skipped']} skipped of {s['total']} in {s['duration_ms']} ms, {e(s['started_at'])}</p>"
            f"<table><tr><th>check</th><th>status</th><th>severity</th><th>observed</th><th>expected</th><th>failing rows</th><th>sample</th></tr>{rows}</table>"
        )
    return _PAGE.substitute(title=e(title), suites="".join(parts))


def fires(alert: Alert, result: SuiteResult) -> bool:
    """on_success, always, or on_failure, which an unknown trigger counts as."""
    trigger = alert.trigger.lower()
    return trigger == "always" or (result.status is Status.PASS if trigger == "on_success" else result.status is Status.FAIL)


def payload(result: SuiteResult) -> dict:
    bad = [r for r in result.results if r.status in (Status.FAIL, Status.ERROR)]
    s = result.summary()
    return {k: s[k] for k in ("suite", "status", "quality_score", "total", "passed", "failed", "errored", "duration_ms")} | {
        "timestamp": s["started_at"],
        "failed_checks": [{"check": r.check.name, "type": r.check.type, "column": r.check.column, "observed": r.observed, "expected": r.expected} for r in bad],
    }


def send(alert: Alert, result: SuiteResult, timeout: float = 10.0) -> bool:
    """Posts a result to a webhook if the alert fires; whether it was taken."""
    if not fires(alert, result):
        return False
    headers = {"Content-Type": "application/json"} | {k: expand(v) for k, v in alert.headers.items()}
    request = urllib.request.Request(expand(alert.url), json.dumps(payload(result)).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (urllib.error.URLError, OSError):
        return False
