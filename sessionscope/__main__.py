"""Run registered queries as Spark jobs.

    spark-submit --py-files sessionscope.zip -m sessionscope run NAME --data DIR --out PATH
    python -m sessionscope list
    python -m sessionscope explain NAME --data DIR

``run`` writes the result with the DataFrame writer (nothing is collected to
the driver).  ``--tables DB`` runs on catalog tables saved by
``ShopTables.save_as_tables`` instead of deriving them from ``DIR/events.parquet``.
"""

from __future__ import annotations

import argparse
import sys

from sessionscope.plans.inspect import plan_text
from sessionscope.plans.registry import QUERIES
from sessionscope.session import build_session
from sessionscope.sources.tables import ShopTables


def _frame(spark, args):
    spec = QUERIES[args.name]
    if args.tables:
        return spec.on(ShopTables.from_tables(spark, args.tables))
    return spec(spark, args.data)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sessionscope")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered query names")
    for cmd in ("run", "explain"):
        p = sub.add_parser(cmd)
        p.add_argument("name", choices=sorted(QUERIES))
        p.add_argument("--data", help="folder that holds events.parquet")
        p.add_argument("--tables", default=None, help="catalog database saved by save_as_tables")
        if cmd == "run":
            p.add_argument("--out", required=True)
            p.add_argument("--format", default="parquet")
            p.add_argument("--mode", default="errorifexists")
    args = parser.parse_args(argv)
    if args.cmd != "list" and not (args.data or args.tables):
        parser.error("name the input: --data or --tables")

    if args.cmd == "list":
        print("\n".join(QUERIES))
        return 0
    spark = build_session(app_name=f"sessionscope-{args.name}")
    df = _frame(spark, args)
    if args.cmd == "explain":
        print(plan_text(df, "formatted"))
    else:
        df.write.mode(args.mode).format(args.format).save(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
