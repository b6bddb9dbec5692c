"""Command line: list the queries, run one over a folder of tables, or search chunks for questions."""

from __future__ import annotations

import argparse

from papyra.plans import catalog
from papyra.session import build_session
from papyra.storage import staging


def main() -> None:
    p = argparse.ArgumentParser(prog="papyra", description=__doc__)
    p.add_argument("query", nargs="?", help="name of a query; none lists them all")
    p.add_argument("folder", nargs="?", help="folder of Parquet tables")
    p.add_argument("--out", help="write the result as Parquet instead of showing it")
    p.add_argument("--master", default="local[*]")
    args = p.parse_args()
    if not args.query or not args.folder:
        print("\n".join(sorted(catalog.QUERIES)))
        return
    spark = build_session("papyra", args.master)
    with staging(spark):
        result = catalog.QUERIES[args.query](spark, args.folder)
        if args.out:
            result.write.parquet(args.out)
        else:
            result.show(20, False)


if __name__ == "__main__":
    main()
