"""Command line: run a configured pipeline on a Spark master."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .runner import Runner


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyverify", description="Align and verify forecasts as a YAML file says.")
    commands = p.add_subparsers(dest="command", required=True)
    local = commands.add_parser("local", help="on this machine")
    local.add_argument("--workers", type=int, default=4, help="threads")
    cluster = commands.add_parser("cluster", help="on a cluster; resources as with spark-submit")
    cluster.add_argument("--master", help="Spark master; else spark-submit's")
    cluster.add_argument("--executors", type=int, default=3)
    cluster.add_argument("--cores", type=int, default=8)
    cluster.add_argument("--memory", default="64g")
    for c in (local, cluster):
        c.add_argument("config", help="YAML file")
    return p


def session(args: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName("skyverify").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if args.command == "local":
        return b.master(f"local[{args.workers}]").getOrCreate()
    b = b.config("spark.executor.instances", args.executors).config("spark.executor.cores", args.cores).config("spark.executor.memory", args.memory)
    return (b.master(args.master) if args.master else b).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(args)
    try:
        metrics = Runner(args.config, spark).run()
        if metrics is not None:
            metrics.show(100, truncate=False)
    except Exception:
        logging.exception("the pipeline failed")
        return 1
    finally:
        if args.command == "cluster":
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
