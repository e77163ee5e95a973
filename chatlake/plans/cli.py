"""Command line: ``ask``, ``stats``, ``corpus build``, ``poll``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from chatlake.functions import vocabulary as v
from chatlake.operators import index
from chatlake.plans.engine import Engine
from chatlake.sources.settings import Settings, confined
from chatlake.streaming.updates import read_json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chatlake")
    p.add_argument("--data", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--mode", default=v.QA, choices=(v.QA, v.CHECKLIST, v.CORRECTION, v.TECHNICAL))
    a.add_argument("--json", action="store_true")
    sub.add_parser("stats")
    c = sub.add_parser("corpus").add_subparsers(dest="action", required=True).add_parser("build")
    c.add_argument("--config", required=True)
    c.add_argument("--output")
    c.add_argument("--allow-hashing", action="store_true")
    c.add_argument("folder")
    t = sub.add_parser("poll")
    t.add_argument("--config", required=True)
    t.add_argument("updates")
    t.add_argument("output")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("chatlake").getOrCreate()
    if args.command == "corpus":
        settings = Settings.load(args.config)
        made = index.build(spark, args.folder, confined(args.output, Path("data/index")) if args.output else settings.index_dir, settings.aliases, allow_hashing=args.allow_hashing, labels=settings.labels)
        print(json.dumps(made, ensure_ascii=False))
        return 0
    engine = Engine(spark)
    if args.command == "poll":
        settings = Settings.load(args.config)
        engine.use(settings.index_dir)
        engine.triage_stream(read_json(spark, args.updates), settings.chat_ids, args.output, f"{args.output}/_checkpoint").awaitTermination()
        return 0
    engine.add_folder(args.data)
    if args.command == "stats":
        print(engine.stats().toJSON().first())
        return 0
    row = engine.ask(args.question, args.mode)
    print(row.toJSON().first() if args.json else row.first().answer)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
