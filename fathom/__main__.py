"""python -m fathom list | run NAME --data DIR [--out DIR] [--limit N] | explain NAME --data DIR | inspect PATH"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import catalog  # noqa: F401
from .queries import ORACLES, QUERIES


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="fathom", description="Run the library's queries on a folder of Parquet tables.")
    sub = top.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="the queries, those with SQL marked")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query", choices=sorted(QUERIES), metavar="NAME")
        p.add_argument("--data", required=True, help="folder of <table>.parquet")
        if name == "run":
            p.add_argument("--out", help="write Parquet there instead of showing rows")
            p.add_argument("--limit", type=int, default=20, help="rows to show")
    sub.add_parser("inspect", help="what the MCAP logs under a path hold").add_argument("path")
    said = top.parse_args(args)
    if said.what == "list":
        print("\n".join(f"{n}{' (SQL)' if n in ORACLES else ''}" for n in sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if said.what == "inspect":
        from .sources.formats import inspect_mcap

        inspect_mcap(spark, said.path).orderBy("path", "topic").show(1000, truncate=False)
        return 0
    df = QUERIES[said.query](spark, said.data)
    if said.what == "explain":
        df.explain("formatted")
    elif said.out:
        df.write.parquet(said.out)
    else:
        df.show(said.limit, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
