"""Command line.

``process-data CONFIG.json OUT`` builds a configured dataset, with a ``type`` down to tokens, and writes it as
Parquet.  ``requests add|step|status|extract|clean FOLDER`` takes a batch of model requests through a transport, which
``--transport module:factory`` names.
"""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession

from lodestone.plans.factory import build
from lodestone.plans.requests import RemoteBatch, extracted


def process_data(spark: SparkSession, config: dict, out: str) -> list[str]:
    """The parts of a configured dataset, written below ``out``; their paths."""
    paths = []
    for name, part in build(spark, config).items():
        paths.append(f"{out.rstrip('/')}/{name}")
        part.write.mode("overwrite").parquet(paths[-1])
    return paths


def user_object(name: str):
    """What ``module:attribute`` names; the module may be the user's own."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run_requests(spark: SparkSession, action: str, folder: str, source: str | None, transport: str | None, shape: str, out: str | None) -> list[str]:
    """One step of a batch of requests; lines to print."""
    batch = RemoteBatch(spark, folder)
    if action == "add":
        return [f"{batch.add(spark.read.parquet(source))} files"]
    if action == "step":
        return ["done" if batch.step(user_object(transport)()) else "pending"]
    if action == "status":
        return [f"{file}\t{state}" for file, state, *_ in batch.state()]
    if action == "extract":
        extracted(batch.responses(), shape).write.parquet(out)
        return [out]
    batch.clean()
    return []


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--code", help="module to import first, such as one that defines sources")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("process-data", help="build a configured dataset")
    one.add_argument("config", help="JSON file, on any file system that Spark reads")
    one.add_argument("out", help="folder for the parts")
    two = commands.add_parser("requests", help="take model requests through a batch service")
    two.add_argument("action", choices=["add", "step", "status", "extract", "clean"])
    two.add_argument("folder")
    two.add_argument("--source", help="Parquet with custom_id and request")
    two.add_argument("--transport", help="module:factory")
    two.add_argument("--shape", default="chat")
    two.add_argument("--out")
    given = parser.parse_args(args)
    if given.code:
        importlib.import_module(given.code)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if given.command == "requests":
        lines = run_requests(spark, given.action, given.folder, given.source, given.transport, given.shape, given.out)
    else:
        lines = process_data(spark, json.loads(spark.read.text(given.config, wholetext=True).first()[0]), given.out)
    print("\n".join(lines))


if __name__ == "__main__":
    main()
