"""Command line: ingest, validate, stats, status."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Settings
from .plans.engine import Engine
from .sources.markdown import exists


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="bring the store up to date with a folder of markdown")
    ingest.add_argument("source", nargs="?")
    ingest.add_argument("--force", action="store_true", help="embed unchanged chunks too")
    for name, told in (("validate", "check that the knowledge base and the store exist"), ("stats", "count the stored chunks"), ("status", "print the server's name and readiness")):
        commands.add_parser(name, help=told)
    args = parser.parse_args(argv)
    settings = Settings.from_env()
    if args.command == "status":
        print(f"{settings.server_name}: ready")
        return 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "ingest":
        s = Engine(spark, settings).ingest(args.source, args.force)
        print(f"{s.documents_processed} documents; chunks: {s.chunks_created} created, {s.chunks_updated} updated, {s.chunks_deleted} deleted; {s.total_time_seconds:.2f} s")
        return 0
    if args.command == "stats":
        print(f"{Engine(spark, settings).stats()} chunks")
        return 0
    wanted = [settings.paths.knowledge_base_path, f"{settings.paths.vectordb_path}/CURRENT"]
    missing = [p for p in wanted if not exists(spark, p)]
    for p in missing:
        print(f"missing: {p}", file=sys.stderr)
    print("ok" if not missing else f"{len(missing)} missing")
    return int(bool(missing))


if __name__ == "__main__":
    sys.exit(main())
