"""``python -m siftwell index|status|search``: JSON on standard output; errors end with code 2."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="siftwell")
    p.add_argument("--data-dir", default="siftwell-data")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("index", "status"):
        verbs.add_parser(verb).add_argument("path")
    s = verbs.add_parser("search")
    s.add_argument("path")
    s.add_argument("query")
    s.add_argument("--mode", default="auto")
    s.add_argument("-k", "--top-k", default=5, type=int)
    s.add_argument("--under")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    from siftwell.engine import Engine

    spark = SparkSession.builder.appName("siftwell").getOrCreate()
    engine = Engine(spark, a.data_dir)
    try:
        out = engine.index(a.path) if a.verb == "index" else engine.status(a.path) if a.verb == "status" else dataclasses.asdict(engine.search(a.path, a.query, a.top_k, a.mode, a.under))
    except (OSError, ValueError) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 2
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
