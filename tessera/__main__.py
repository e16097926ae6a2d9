"""python -m tessera index TREE STORE | status STORE | doctor STORE: indexing from a shell, a line of JSON as the answer."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession

from tessera.limits import RequestError
from tessera.plans.indexing import Indexer
from tessera.sources import guarded, scan
from tessera.sources.store import Store


def doctor(indexer: Indexer) -> dict:
    """Checks of a store: that its registry can be read, what is active, and which edges contradict themselves or their files."""
    from tessera.schema import edge_faults, membership_faults

    registry = indexer.store.registry()
    found = {"registry": "ok", "active": registry["active"], "building": [g["generation_id"] for g in registry["generations"] if g["status"] == "building"]}
    if registry["active"]:
        index = indexer.open()
        found |= {"edge_faults": edge_faults(index.edges).count(), "membership_faults": membership_faults(index.edges, index.files).count()}
    return found


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with the error's code."""
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "status", "doctor"):
        command = commands.add_parser(name)
        if name == "index":
            command.add_argument("tree")
            command.add_argument("--guarded", action="store_true", help="follow no links, and take no file that changes while it is read")
            command.add_argument("--key", default=None, help="a request of the same key is not run again")
        command.add_argument("store")
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    indexer = Indexer(Store(spark, asked.store))
    try:
        if asked.command == "index":
            files = (guarded if asked.guarded else scan).tree(spark, asked.tree)
            own = uuid.uuid4().hex
            answer = indexer.run(files, asked.key or own, f"g-{own}", scan.ignore_rules(files))
        else:
            answer = indexer.status() if asked.command == "status" else doctor(indexer)
    except RequestError as error:
        print(json.dumps({"error": str(error)}))
        return 1
    print(json.dumps(answer, default=str))
    return 0 if asked.command != "index" or answer["state"] == "completed" else 1


if __name__ == "__main__":
    sys.exit(main())
