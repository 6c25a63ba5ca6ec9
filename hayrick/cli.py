"""python -m hayrick.cli index|search|map|status|workspaces|doctor"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from hayrick import render
from hayrick.api import Hayrick
from hayrick.sources.symbols import PARSED, preflight


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hayrick")
    parser.add_argument("--base", help="folder of the indexes")
    parser.add_argument("--json", action="store_true", help="the whole answer as JSON")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "map", "status", "workspaces", "doctor"):
        p = sub.add_parser(name)
        if name == "search":
            p.add_argument("query")
            p.add_argument("-k", type=int, default=10)
            p.add_argument("--mode", default="balanced")
            p.add_argument("--intent", default="implementation")
        if name == "map":
            p.add_argument("glob", nargs="?", default="**")
        if name == "index":
            p.add_argument("--rebuild", action="store_true")
        if name in ("index", "search", "map", "status"):
            p.add_argument("--repo", default=os.getcwd())
    args = parser.parse_args(argv)
    if args.command == "doctor":
        broken = preflight(sorted(PARSED))
        print(json.dumps({"ok": not broken, "languages": sorted(PARSED), "broken": broken}))
        return 1 if broken else 0
    spark = SparkSession.builder.appName("hayrick").config("spark.ui.enabled", "false").getOrCreate()
    engine = Hayrick(spark, args.base)
    calls = {
        "index": lambda: engine.refresh(args.repo, args.rebuild),
        "search": lambda: engine.search(args.query, args.repo, args.k, args.mode, args.intent),
        "map": lambda: engine.map(args.glob, args.repo),
        "status": lambda: engine.status(args.repo),
        "workspaces": engine.list_workspaces,
    }
    answer = calls[args.command]()
    print(json.dumps(answer, indent=2, default=str) if args.json else render.answer(args.command, answer))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
