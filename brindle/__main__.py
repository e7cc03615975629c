"""python -m brindle QUERY --data DIR [--run OUT]: the plan of a query; with --run, its rows as
Parquet in OUT."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from brindle.operators.jobs import prepare
from brindle.plans import builds, corpus, dialogues, evaluation, generated, recipes, storage
from brindle.plans.registry import QUERIES

PLANS = (builds, corpus, dialogues, evaluation, generated, recipes, storage)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brindle", description=__doc__)
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--run", metavar="OUT", help="write the rows here; without it only the plan is shown")
    own = parser.parse_args(argv)
    rows = prepare(QUERIES, own.query, spark or SparkSession.builder.getOrCreate(), own.data)
    if own.run:
        rows.write.mode("errorifexists").parquet(own.run)
    else:
        rows.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main())
