"""``python -m quern``: list and run queries over a folder of tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from quern.plans import problems, reference, roundtrips  # noqa: F401
from quern.plans.pipeline import clean
from quern.session import local_session


def main(arguments: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and write or show its rows")
    run.add_argument("query")
    run.add_argument("--data", required=True, help="folder with one Parquet table per name")
    run.add_argument("--out", help="Parquet folder to write; without it 20 rows are shown")
    run.add_argument("--explain", action="store_true", help="show the plan only")
    tidy = commands.add_parser("clean", help="delete owned outputs under a folder")
    tidy.add_argument("root")
    tidy.add_argument("names", nargs="+")
    tidy.add_argument("--yes", action="store_true", help="really delete")
    given = parser.parse_args(arguments)

    queries = problems.QUERIES | reference.QUERIES
    if given.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if given.command == "clean":
        for path in clean(given.root, given.names, dry_run=not given.yes):
            print(("deleted " if given.yes else "would delete ") + str(path))
        return 0
    if given.query not in queries:
        print(f"unknown query {given.query}", file=sys.stderr)
        return 2
    df = queries[given.query](local_session("quern"), given.data)
    if given.explain:
        df.explain("formatted")
    elif given.out:
        df.write.mode("overwrite").option("compression", "zstd").parquet(given.out)
    else:
        df.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
