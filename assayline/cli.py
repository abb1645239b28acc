"""Command line: init, run, watch, validate, profile, history, contract, import, export, version."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import plugins
from .functions.scalars import interval_seconds, interval_text
from .model import Source, Status
from .operators.profile import profile, suggest
from .plans import config as configs
from .plans.contracts import diff, validate
from .plans.engine import Engine
from .sources import convert, outputs
from .sources.resolve import resolve
from .sources.store import Store

VERSION = "0.1.0"
_TEMPLATE = """source:
  type: spark
  table: orders

checks:
  - not_null: [order_id, customer_id]
  - unique: order_id
  - range: {column: amount, min: 0}
  - row_count: {min: 1}
"""


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("assayline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assayline", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *positional: str, config: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        if config:
            p.add_argument("--config", "-c", default="assayline.yaml")
        return p

    add("init", config=False).add_argument("--path", default="assayline.yaml")
    for name in ("run", "watch"):
        p = add(name)
        p.add_argument("--suite", action="append")
        p.add_argument("--tag", action="append")
        p.add_argument("--format", choices=("table", "json", "csv"), default="table")
        p.add_argument("--store")
        p.add_argument("--html")
        p.add_argument("--no-optimize", action="store_true")
        p.add_argument("--no-alerts", action="store_true")
        if name == "watch":
            p.add_argument("--interval", default="5m")
            p.add_argument("--times", type=int)
    add("validate")
    p = add("profile")
    p.add_argument("--table")
    p.add_argument("--column", action="append")
    p.add_argument("--sample", type=float)
    p.add_argument("--suggest", action="store_true")
    p = add("history", config=False)
    p.add_argument("--store", required=True)
    p.add_argument("--suite")
    p.add_argument("--run")
    p.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("contract").add_subparsers(dest="action", required=True)
    p = c.add_parser("validate")
    p.add_argument("--config", "-c", default="assayline.yaml")
    p.add_argument("--name")
    p = c.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p = sub.add_parser("import").add_subparsers(dest="kind", required=True).add_parser("soda")
    p.add_argument("file")
    p.add_argument("--source-type", default="spark")
    p.add_argument("--output")
    p = sub.add_parser("export").add_subparsers(dest="kind", required=True).add_parser("dbt")
    p.add_argument("--config", "-c", default="assayline.yaml")
    p.add_argument("--output")
    sub.add_parser("version")
    return top


def _emit(text: str, path: str | None) -> None:
    if path:
        Path(path).write_text(text, encoding="utf-8")
    else:
        print(text)


def _contract_frame(spark: SparkSession, config, contract):
    source = contract.source
    if isinstance(source, str):
        source = config.sources.get(source) or (config.suites[0].source if config.suites else Source())
    return resolve(spark, dataclasses.replace(source, table=contract.table or source.table))


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    config = configs.load(args.config)
    engine = Engine(spark, config, Store(spark, args.store) if args.store else None)
    results = engine.run(args.suite, args.tag, fuse=not args.no_optimize)
    print({"table": lambda r: "\n\n".join(map(outputs.as_table, r)), "json": outputs.as_json, "csv": outputs.as_csv}[args.format](results))
    code = int(any(r.status is Status.FAIL for r in results))
    for contract in config.contracts:
        try:
            found = validate(_contract_frame(spark, config, contract), contract)
        except Exception as e:
            print(f"Contract {contract.name}: error: {str(e).splitlines()[0]}")
            code = 1
            continue
        if args.format == "table":
            print(f"Contract {found.contract}: {found.status}" + "".join(f"\n  {v.rule}: {v.message}" for v in found.violations))
        code = max(code, int(found.status == "fail"))
    if not args.no_alerts:
        for result in results:
            for alert in config.alerts:
                outputs.send(alert, result)
    if args.html:
        _emit(outputs.as_html(results), args.html)
    return code


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    plugins.load()
    command = args.command
    if command == "version":
        print(VERSION)
        return 0
    if command == "init":
        path = Path(args.path)
        if path.exists():
            print(f"{path} exists", file=sys.stderr)
            return 1
        path.write_text(_TEMPLATE, encoding="utf-8")
        return 0
    if command == "import":
        _emit(convert.from_soda(Path(args.file).read_text(encoding="utf-8"), args.source_type), args.output)
        return 0
    if command == "export":
        _emit(convert.to_dbt(configs.load(args.config)), args.output)
        return 0
    if command == "validate":
        found = configs.problems(configs.load(args.config))
        print("\n".join(found) or "valid")
        return int(bool(found))
    if command == "contract" and args.action == "diff":
        old, new = (configs.load(p).contracts for p in (args.old, args.new))
        by_name = {c.name: c for c in old}
        changes = [x for c in new if c.name in by_name for x in diff(by_name[c.name], c)]
        print(json.dumps([dataclasses.asdict(x) for x in changes], indent=2))
        return int(any(x.breaking for x in changes))
    spark = spark or spark_session()
    if command == "run":
        return _run(args, spark)
    if command == "watch":
        wait, code, n = interval_seconds(args.interval), 0, 0
        while args.times is None or n < args.times:
            if n:
                print(f"next run in {interval_text(wait)}")
                time.sleep(wait)
            code, n = _run(args, spark), n + 1
        return code
    if command == "profile":
        config = configs.load(args.config)
        source = config.suites[0].source if config.suites else next(iter(config.sources.values()))
        if args.table:
            source = dataclasses.replace(source, table=args.table)
        found = profile(resolve(spark, source), source.table, args.column, args.sample)
        print(configs.dump(suggest(found), source.type, source.table) if args.suggest else json.dumps(dataclasses.asdict(found), default=str, indent=2))
        return 0
    if command == "history":
        store = Store(spark, args.store)
        for row in (store.details(args.run) if args.run else store.runs(args.suite, args.limit)).collect():
            print(json.dumps(row.asDict(), default=str))
        return 0
    config, code = configs.load(args.config), 0
    for contract in config.contracts:
        if args.name in (None, contract.name):
            found = validate(_contract_frame(spark, config, contract), contract)
            print(json.dumps(dataclasses.asdict(found), indent=2))
            code = max(code, int(found.status == "fail"))
    return code


if __name__ == "__main__":
    sys.exit(main())
