"""python -m ledgerlark: lists the queries. python -m ledgerlark NAME FOLDER [OUT]: shows a query's first rows, or writes all to OUT.
python -m ledgerlark COMMAND HOME ...: a command over a folder of tables; COMMAND --help tells its arguments."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from . import commands
    from .plans.registry import QUERIES

    if not args:
        for name, f in sorted(QUERIES.items()):
            print(name, (f.__doc__ or "").strip(), sep="\t")
        return 0
    if callable(f := getattr(commands, args[0], None)) and getattr(f, "__module__", "") == commands.__name__ and args[0] not in ("run", "parser"):
        from pyspark.sql import SparkSession

        commands.run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args).show(100, truncate=80)
        return 0
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rows = QUERIES[args[0]](spark, args[1].rstrip("/"))
    if len(args) == 3:
        rows.write.mode("overwrite").parquet(args[2])
    else:
        rows.show(20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
