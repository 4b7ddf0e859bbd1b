"""Commands over a state root: python -m lorekeel STATE COMMAND …; every answer is one JSON line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import CorpusError
from .plans.folders import Folder, Registry
from .plans.storage import Storage
from .plans.sync import SyncEngine
from .schemas import ARTIFACTS, SCHEMA_VERSION
from .session import ship


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeel", description=__doc__)
    top.add_argument("state")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("folders")
    add = commands.add_parser("add-folder")
    for name in ("folder_id", "url", "alias"):
        add.add_argument(name)
    for name in ("enable", "disable", "remove"):
        commands.add_parser(name).add_argument("identifier")
    rename = commands.add_parser("rename")
    rename.add_argument("identifier")
    rename.add_argument("alias")
    for name in ("status", "recover"):
        commands.add_parser(name)
    for name in ("validate", "plan", "sync"):
        p = commands.add_parser(name)
        p.add_argument("inventory")
        if name == "sync":
            p.add_argument("artifacts")
            p.add_argument("payloads")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--folder", action="append")
    ask.add_argument("--threshold", type=float, default=0.45)
    ask.add_argument("--limit", type=int, default=8)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    from .streaming.snapshots import read_inventory

    command = args.command
    if command in ("folders", "add-folder", "enable", "disable", "remove", "rename"):
        registry = Registry(Storage(spark, args.state))
        if command == "add-folder":
            registry.add(Folder(args.folder_id, args.url, args.alias))
        elif command == "rename":
            registry.rename(args.identifier, args.alias)
        elif command != "folders":
            getattr(registry, command)(args.identifier)
        return {"status": "OK", "folders": [vars(f) for f in registry.list()]}
    engine = SyncEngine(spark, args.state)
    if command == "status":
        return {"status": "OK"} | engine.status()
    if command == "recover":
        return {"status": engine.recover()}
    if command == "ask":
        rows = engine.ask(args.question, args.folder, args.threshold, args.limit).collect()
        partial = engine.header()["coverage"] == "partial"
        return {"status": "PARTIAL_INDEX" if partial else "OK", "evidence": [r.asDict() for r in rows]}
    snapshot = read_inventory(spark, args.inventory)
    if command == "validate":
        from .operators import inventory

        inventory.require_none(inventory.file_violations(snapshot.files, list(snapshot.root_ids)), "INVALID_INVENTORY")
        return {"status": "OK", "complete": snapshot.complete} | inventory.inventory_counts(snapshot.files).first().asDict()
    if command == "plan":
        from .operators.inventory import plan_counts

        return {"status": "OK", "counts": {r["action"]: r["files"] for r in plan_counts(engine.plan(snapshot)).collect()}}
    artifacts = spark.read.schema(ARTIFACTS).option("mode", "FAILFAST").json(args.artifacts)
    return {"status": engine.apply(snapshot, artifacts, args.payloads)}


def main(argv: list[str] | None = None) -> int:
    """0 done, 2 a typed error, 1 anything else."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    head = {"schema_version": SCHEMA_VERSION, "operation": args.command}
    try:
        print(json.dumps(head | run(spark, args), ensure_ascii=False, sort_keys=True))
        return 0
    except CorpusError as error:
        print(json.dumps(head | {"status": error.code, "message": str(error)}, ensure_ascii=False, sort_keys=True))
        return 2
    except Exception as error:  # noqa: BLE001
        print(json.dumps(head | {"status": "UNEXPECTED_ERROR", "message": type(error).__name__}, sort_keys=True))
        return 1


if __name__ == "__main__":
    sys.exit(main())
