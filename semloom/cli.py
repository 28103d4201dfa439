"""Commands: status, config, build, update, search, import, verify, demo. Run as ``python -m semloom.cli``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from semloom.plans import acceptance, demo
from semloom.plans.engine import Config, Engine
from semloom.sources import corpus
from semloom.streaming import updates


def home() -> str:
    return os.environ.get("SEMLOOM_HOME") or os.path.expanduser("~/.semloom")


def _config(args) -> Config:
    path = args.config or os.path.join(home(), "config.json")
    return Config.load(path) if os.path.exists(path) else Config(os.path.join(home(), "store"), os.path.join(home(), "sessions.db"))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="semloom")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command")
    for name in ("status", "config", "build", "update"):
        commands.add_parser(name)
    commands.add_parser("search").add_argument("query")
    commands.add_parser("import").add_argument("source", help="a SQLite file with a facts table")
    verify = commands.add_parser("verify")
    verify.add_argument("checks", help="JSON with semantic_pairs, noise_pairs, probe_tests and documents")
    commands.add_parser("demo").add_argument("folder")
    args = top.parse_args(argv)
    config = _config(args)
    if args.command == "config":
        print(json.dumps(config.__dict__, indent=2))
        return 0
    if args.command == "demo":
        print(*demo.write(args.folder))
        return 0
    spark = SparkSession.builder.appName("semloom").getOrCreate()
    engine = Engine(spark, config)
    if args.command not in ("build", "import"):
        engine.open(background=False)
    if args.command == "build":
        model = engine.build()
        print(f"{model.vocabulary.where('idx IS NOT NULL').count()} words from {model.sentences} sentences")
    elif args.command == "update":
        taken = engine.update() if config.format == "sessions" else updates.absorb_files(engine, config.corpus)
        print(f"{taken} sentences")
    elif args.command == "search":
        for r in engine.search(args.query).collect():
            print(f"{r['score']:+.4f}  {r['fact_id']}  {r['text'][:200]}")
    elif args.command == "import":
        from semloom.sources.sqlite import read_sqlite

        print(f"{engine.import_facts(read_sqlite(spark, args.source, 'facts', 'fact_id'))} facts")
    elif args.command == "verify":
        with open(args.checks, encoding="utf-8") as f:
            checks = json.load(f)
        failed = acceptance.verify(engine.model(), corpus.Documents(spark, checks.get("documents", [])).documents(), checks)
        print("\n".join(failed) or "passed")
        return int(bool(failed))
    else:
        print(json.dumps(engine.status()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
