"""Command line: init, config, index, search, status, cleanup."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from fathomix import plainyaml
from fathomix.assistant import local_model
from fathomix.config import Config, SettingError, change
from fathomix.guard import local_only

FLAG = {"action": "store_true"}
#: Each command with its arguments, as argparse takes them.
COMMANDS: dict[str, dict[str, dict]] = {
    "init": {},
    "config": {"action": {"choices": ["show", "set"]}, "key": {"nargs": "?"}, "value": {"nargs": "?"}, "--json": FLAG},
    "index": {
        "--roots": {"nargs": "*", "default": []},
        "--once": FLAG | {"help": "one run, which is the default"},
        "--daemon": FLAG | {"help": "rescan until stopped, and wait while the load is high"},
        "--rescan": FLAG | {"help": "drop the index first"},
        "--dry-run": FLAG,
    },
    "search": {
        "query": {},
        "--top": {"type": int, "default": 20},
        "--type": {"choices": ["text", "pdf", "image", "audio", "video", "archive"]},
        "--path": {},
        "--since": {},
        "--json": FLAG,
        "--no-llm": FLAG | {"help": "ask no language model"},
    },
    "status": {"--json": FLAG},
    "cleanup": {"--all": FLAG | {"help": "the whole index, not only what is left over"}},
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomix")
    p.add_argument("--home", default=os.environ.get("FATHOMIX_HOME", os.path.expanduser("~/.fathomix")))
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        command = sub.add_parser(name)
        for argument, options in arguments.items():
            command.add_argument(argument, **options)
    return p


def settings(args: argparse.Namespace, config: Config, path: str) -> int:
    if args.action == "set":
        try:
            change(config, args.key or "", args.value or "")
        except SettingError as e:
            print(e, file=sys.stderr)
            return 2
        config.save(path)
    print(json.dumps(config.to_dict(), indent=2) if args.json else plainyaml.dump(config.to_dict()), end="")
    return 0


def index(args: argparse.Namespace, config: Config, engine) -> int:
    from fathomix.monitor import Gate

    roots = args.roots or config.roots
    if args.dry_run:
        for row in engine.scan(roots).select("path").orderBy("path").toLocalIterator():
            print(row.path)
        return 0
    if args.rescan:
        engine.wipe()
    gate = Gate(config.load) if args.daemon else None
    while True:
        print(json.dumps(engine.index(roots, gate)), flush=True)
        if not args.daemon or args.once:
            return 0
        time.sleep(config.indexing.rescan_interval_s)


def search(args: argparse.Namespace, config: Config, engine) -> int:
    from fathomix.operators.hybrid import as_lines

    ask = None if args.no_llm else local_model(config.language_model, config.security)
    found = engine.search(args.query, args.top, args.type, args.path, args.since, ask)
    for row in as_lines(found).collect():  # at most --top rows
        print(row.json if args.json else f"{row.line}\n  {row.shown}" if row.shown else row.line)
    return 0


def status(args: argparse.Namespace, config: Config, engine) -> int:
    state, rows = engine.state(), [r.asDict() for r in engine.status().collect()]
    if args.json:
        print(json.dumps(state | {"files": rows}))
        return 0
    counts = " | ".join(f"{k}: {state.get(k, 0)}" for k in ("enqueued", "processed", "skipped", "errors"))
    print(f"{counts} | index: {state['index_bytes'] / 2**20:.1f} MB | vectors: {state['vector_bytes'] / 2**20:.1f} MB")
    if state.get("paused"):
        print(f"paused: {state.get('pause_reason')} for {state.get('paused_for_s') or 0:.0f} s")
    for r in rows:
        print(f"{r['status']:9} {r['type']:8} {r['n_files']:8} files {r['size_bytes']} bytes")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    path = os.path.join(args.home, "config.yaml")
    config = Config.read(path) if os.path.exists(path) else Config()
    if args.command == "init":
        os.makedirs(args.home, exist_ok=True)
        if not os.path.exists(path):
            config.save(path)
        print(path)
        return 0
    if args.command == "config":
        return settings(args, config, path)

    from pyspark.sql import SparkSession

    from fathomix.engine import Engine

    spark = SparkSession.builder.appName("fathomix").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, f"file://{os.path.abspath(args.home)}/index", config)
    if args.command == "cleanup":
        print(f"removed: {len(engine.cleanup(args.all))} folders" + (" and the index" if args.all else ""))
        return 0
    with local_only(config.security.allowed_hosts, config.security.local_only):
        return {"index": index, "search": search, "status": status}[args.command](args, config, engine)
