"""python -m loomlog QUERY TABLES: run a registered query of the log and print its first rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import catalog


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in catalog.QUERIES:
        print(__doc__, "\nQueries:", *sorted(catalog.QUERIES), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"loomlog {args[0]}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog.QUERIES[args[0]](spark, args[1]).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
