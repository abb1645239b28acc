"""Sources, configuration, outputs, converters, command line and streams."""

import http.server
import json
import threading
from dataclasses import replace
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
import yaml

from assayline import cli
from assayline.model import Alert, Check, Source, Status
from assayline.operators.checks import KINDS, CheckError, Context, Kind, register_plugin
from assayline.plans import config as configs
from assayline.plans.engine import Engine, check_frame
from assayline.sources import convert, outputs
from assayline.sources.resolve import describe, expand, file_call, register_connector, resolve
from assayline.streaming import windows


def test_sources(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "a.json").write_text('{"id": 1}\n')
    assert resolve(spark, Source("parquet", str(tmp_path), "t")).count() == 3
    assert resolve(spark, Source(table=f"read_csv('{tmp_path}/a.csv')")).schema["id"].dataType.simpleString() == "int"
    assert resolve(spark, Source(table=f'read_json_auto("{tmp_path}/a.json")')).count() == 1
    monkeypatch.setenv("PLACE", str(tmp_path))
    assert resolve(spark, Source(table="read_parquet('${PLACE}/t.parquet')")).count() == 3
    assert resolve(spark, pd.DataFrame({"a": [1, 2]})).count() == 2 and resolve(spark, pa.table({"a": [1]})).count() == 1
    assert describe(spark.range(1))[0]["type"] == "bigint"
    with pytest.raises(ValueError):
        expand("${NOT_SET_ANYWHERE}")
    assert expand("$PLAIN") == "$PLAIN"
    for bad in ("read_csv('x') UNION SELECT 1", "t; DROP TABLE x"):
        with pytest.raises(ValueError):
            resolve(spark, Source(table=bad))
    for kind in ("pandas", "nonsense", "kafka"):
        with pytest.raises(ValueError):
            resolve(spark, Source(kind, table="t"))
    with pytest.raises(ValueError):
        register_connector("postgres", lambda s, x: None)
    register_connector("numbers", lambda s, x: s.range(int(x.table)))
    assert resolve(spark, Source("numbers", table="4")).count() == 4
    assert file_call("plain") is None


def test_plugins():
    with pytest.raises(ValueError):
        register_plugin(Kind("not_null", lambda *a: None))
    register_plugin(Kind("always", KINDS["row_count"].verdict, fused=KINDS["row_count"].fused))
    assert "always" in KINDS


CONFIG = """
sources:
  folder: {type: parquet, connection: PLACE}
suites:
  - name: first
    source: folder
    table: t
    tags: [daily]
    checks: ["not_null: id", {range: {column: id, min: 5}, severity: warning}, {referential_integrity: {column: id, reference_table: t, reference_column: id}}]
  - name: second
    source: {type: parquet, connection: PLACE, table: t}
    checks: [{row_count: {min: 100}}]
contracts:
  - name: c
    source: folder
    table: t
    schema: {columns: [{name: id, type: bigint, checks: [not_null]}]}
alerts:
  - {type: webhook, url: "http://127.0.0.1:1/x", trigger: on_failure}
"""


@pytest.fixture
def config_file(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    path = tmp_path / "conf.yaml"
    path.write_text(CONFIG.replace("PLACE", str(tmp_path)))
    return path


def test_config(spark, config_file):
    config = configs.load(config_file)
    assert [s.name for s in config.suites] == ["first", "second"] and config.contracts[0].columns[0].checks == ("not_null",) and config.alerts
    results = Engine(spark, config).run(tags=["daily"])
    assert [str(r.status) for r in results[0].results] == ["pass", "warn", "pass"]
    assert configs.problems(config) == []
    bad = configs.from_dict({"source": {"table": "t"}, "checks": [{"nope": "a"}, {"range": {"column": "a", "mn": 1}}, {"anomaly": {"column": "a"}}, {"not_null": {"column": "a", "severity": "dire"}}]})
    assert len(configs.problems(bad)) == 4
    for raw in ({"suites": [{"name": "x", "source": "unknown"}]}, {"source": {"tabel": "t"}, "checks": []}):
        with pytest.raises(ValueError):
            configs.from_dict(raw)


def test_command_line(spark, config_file, tmp_path, capsys):
    run = lambda *a: (cli.main([*a], spark), capsys.readouterr().out)
    store = str(tmp_path / "store")
    code, out = run("run", "-c", str(config_file), "--format", "json", "--store", store, "--html", str(tmp_path / "r.html"))
    assert code == 1 and [s["status"] for s in json.loads(out)] == ["pass", "fail"] and "<table>" in (tmp_path / "r.html").read_text()
    assert run("run", "-c", str(config_file), "--suite", "first", "--no-alerts", "--no-optimize")[0] == 0
    assert run("run", "-c", str(config_file), "--suite", "first", "--format", "csv", "--no-alerts")[1].startswith("suite,check_name")
    assert run("watch", "-c", str(config_file), "--suite", "first", "--interval", "1s", "--times", "2", "--no-alerts")[0] == 0
    assert '"suite_name": "first"' in run("history", "--store", store)[1]
    assert run("validate", "-c", str(config_file)) == (0, "valid\n")
    assert "not_null" in run("profile", "-c", str(config_file), "--suggest")[1]
    assert run("contract", "validate", "-c", str(config_file))[0] == 0
    assert run("contract", "diff", str(config_file), str(config_file)) == (0, "[]\n")
    assert "models" in run("export", "dbt", "-c", str(config_file))[1]
    assert run("init", "--path", str(tmp_path / "new.yaml"))[0] == 0 and configs.load(tmp_path / "new.yaml").suites
    assert run("init", "--path", str(tmp_path / "new.yaml"))[0] == 1
    assert run("version")[0] == 0


def test_html_escapes(spark):
    df = spark.createDataFrame([("<script>",)], "v string")
    page = outputs.as_html([check_frame(df, [{"regex": {"column": "v", "pattern": "^a", "severity": "critical"}}], name="<b>")])
    assert "<script>" not in page and "&lt;script&gt;" in page and "<b>" not in page


def test_alerts(spark):
    got = []

    class Hook(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    bad, good = (check_frame(spark.range(n), [{"row_count": {"min": 1}}]) for n in (0, 1))
    assert outputs.send(Alert(url=url), bad) and got[0]["failed_checks"][0]["type"] == "row_count"
    assert not outputs.send(Alert(url=url), good) and outputs.send(Alert(url=url, trigger="on_success"), good) and outputs.send(Alert(url=url, trigger="always"), good)
    server.shutdown()
    assert not outputs.send(Alert(url="http://127.0.0.1:1/"), bad)


def test_soda_and_dbt():
    soda = """
checks for orders:
  - missing_count(id) = 0
  - duplicate_count(id) = 0
  - missing_percent(name) < 5%
  - row_count > 10
  - freshness(made) < 2D
  - invalid_count(cur) = 0:
      valid values: [EUR, USD]
  - schema:
      fail:
        when required column missing: [a, b]
  - avg(x) between 1 and 2
"""
    out = convert.from_soda(soda)
    checks = yaml.safe_load(out)["checks"]
    assert checks == [
        {"not_null": "id"}, {"unique": "id"}, {"completeness": {"column": "name", "min": 0.95}}, {"row_count": {"min": 11}},
        {"freshness": {"column": "made", "max_age": "2d"}}, {"accepted_values": {"column": "cur", "values": ["EUR", "USD"]}}, {"not_null": "a"}, {"not_null": "b"},
    ]
    assert "avg(x) between 1 and 2" in out
    config = configs.from_dict({"source": {"table": "t"}, "checks": [{"not_null": ["a", "b"]}, {"range": {"column": "a", "min": 1, "max": 2}}, "freshness: made"]})
    made = convert.to_dbt(config)
    columns = yaml.safe_load(made)["models"][0]["columns"]
    assert columns[0] == {"name": "a", "tests": ["not_null", {"dbt_utils.accepted_range": {"min_value": 1, "max_value": 2}}]} and "freshness:made" in made


def test_soda_expressions():
    """Comparisons, bounds and options; several tables make several suites."""
    soda = """
checks for a:
  - row_count between 5 and 10
  - row_count < 3
  - row_count = 4
  - duplicate_count(x, y) = 0
  - missing_count(x) < 1
  - missing_count(x) < 5
  - min(x) >= 0.5
  - max(x) > 3
  - invalid_percent(x) < 2 %
  - invalid_count(mail) = 0:
      valid format: email
  - invalid_count(code) = 0:
      valid min: 1
checks for b:
  - freshness(t) < 1 d
  - schema:
      fail:
        when forbidden column present: [z]
"""
    out = convert.from_soda(soda)
    first, second = yaml.safe_load(out)["suites"]
    assert first["checks"] == [
        {"row_count": {"min": 5, "max": 10}}, {"row_count": {"max": 2}}, {"row_count": {"min": 4, "max": 4}}, {"unique_combination": ["x", "y"]}, {"not_null": "x"},
        {"range": {"column": "x", "min": 0.5}}, {"email_validation": "mail"}, {"range": {"column": "code", "min": 1}},
    ]
    assert second == {"name": "b", "source": {"type": "spark", "table": "b"}, "checks": [{"freshness": {"column": "t", "max_age": "1d"}}]}
    assert [line for line in out.split("\n") if line.startswith("# ")] == ["# Not translated:", "# a: missing_count(x) < 5", "# a: max(x) > 3", "# a: invalid_percent(x) < 2 %", "# b: schema"]
    assert [s.name for s in configs.from_dict(yaml.safe_load(out)).suites] == ["a", "b"]


def test_window_verdicts_equal_batch_verdicts(spark):
    """Every check that can run on windows, over four types and three severities."""
    rows = [(datetime(2024, 1, 1, k % 24), float(k % 3), k % 2 == 0, "ab"[k % 2], datetime(2024, 1, 1 + k % 2).date(), datetime(2024, 1, 1, 1)) for k in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, d double, b boolean, s string, day date, seen timestamp_ntz")
    listed = lambda c, v: Check("accepted_values", c, params={"values": v})
    base = [
        Check("not_null", "s"), Check("completeness", "s"), listed("d", [0, 1, "2.0"]), listed("d", [1]), listed("b", [True, "false"]), listed("b", [True]), listed("s", ["a", "b"]), listed("s", ["a"]),
        listed("day", ["2024-01-01", "2024-01-02"]), listed("day", ["2024-01-01"]), Check("range", "d", params={"max": 1}), Check("regex", "s", params={"pattern": "a"}), Check("email_validation", "s"),
        Check("latency", params={"source_column": "seen", "target_column": "ts", "max_latency": "1h"}), Check("row_count", params={"min": 41}),
    ]
    assert {c.type for c in base} == {k for k, v in KINDS.items() if v.fused and k not in windows.BATCH_ONLY and k in configs.PARAMETERS}
    checks = [replace(c, severity=s) for c in base for s in (None, "info", "critical")]
    batch = check_frame(df, checks, samples=False).results
    (row,) = windows.windowed(df, windows.tumbling("ts", "1 day"), windows.check_metrics(df, checks, Context(spark))).collect()
    window = windows.verdicts(row.asDict(), checks, Context(spark))
    assert [(r.check.name, r.status, r.severity, r.observed, r.failing_rows) for r in window] == [(r.check.name, r.status, r.severity, r.observed, r.failing_rows) for r in batch]
    assert {str(r.status) for r in batch} == {"pass", "fail", "warn"}


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * k), None if k % 4 == 0 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    checks = [Check("not_null", "v"), Check("range", "v", params={"max": 50}), Check("row_count", params={"min": 1})]
    seen = {}
    stream = windows.read_stream(spark, "parquet", df.schema, path=str(tmp_path / "in"))
    query = windows.watch(stream, windows.tumbling("ts", "1 hour"), checks, "ts", "10 minutes", lambda row, results: seen.update({row.window_start: [(r.status, r.observed) for r in results]}), str(tmp_path / "cp"))
    query.awaitTermination(120)
    context = Context(spark)
    batch = windows.windowed(df, windows.tumbling("ts", "1 hour"), windows.check_metrics(df, checks, context)).collect()
    want = {r.window_start: [(x.status, x.observed) for x in windows.verdicts(r.asDict(), checks, context)] for r in batch}
    assert seen and seen.items() <= want.items() and len(want) - len(seen) <= 1
    assert seen[start][0] == (Status.FAIL, "3 nulls")
    for kind in windows.BATCH_ONLY:
        with pytest.raises(CheckError):
            windows.check_metrics(df, [Check(kind, "v")], context)
    sent = spark.createDataFrame([('{"a": 1}',), ("nonsense",)], "m string")
    assert [r.valid for r in windows.messages(sent, "m", "a int").collect()] == [True, False]


def test_workflow_steps(spark, config_file):
    from assayline.orchestrate import QualityError, checked, run_config

    assert run_config(str(config_file), spark, suites=["first"])[0]["status"] == "pass"
    with pytest.raises(QualityError) as e:
        run_config(str(config_file), spark)
    assert "second: row_count" in str(e.value)

    @checked("not_null: id", {"row_count": {"max": 3}})
    def made(n):
        return spark.range(n)

    assert made(3).count() == 3
    with pytest.raises(QualityError):
        made(4)


def test_entry_points_are_loaded(monkeypatch):
    from assayline import plugins

    class Point:
        def __init__(self, name, thing):
            self.name, self.load = name, lambda: thing

    kind = Kind("from_a_plugin", KINDS["row_count"].verdict, fused=KINDS["row_count"].fused)
    found = {"assayline.checks": [Point("ok", kind), Point("taken", Kind("unique", None))], "assayline.connectors": [Point("mine", lambda s, x: s.range(1)), Point("csv", None)]}
    monkeypatch.setattr(plugins, "entry_points", lambda group: found[group])
    with pytest.warns(UserWarning):
        assert plugins.load() == ["ok", "mine"]
    assert "from_a_plugin" in KINDS


def test_anomalies_of_windows(spark):
    history = spark.createDataFrame([(10.0 + k % 3,) for k in range(12)], "value double")
    now = spark.createDataFrame([(11.0,), (90.0,)], "total double")
    assert [r.is_anomaly for r in windows.anomalous(now, "total", history).orderBy("total").collect()] == [False, True]
    assert [r.is_anomaly for r in windows.anomalous(now, "total", history.limit(2)).collect()] == [None, None]
