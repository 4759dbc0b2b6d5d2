"""python -m textloom.cli: list queries, run one, explain its plan, or build a dataset.

    python -m textloom.cli list
    python -m textloom.cli run macro_f1 --tables DIR [--out DIR] [--limit N]
    python -m textloom.cli plan exact_dedup --tables DIR
    python -m textloom.cli build --snippets DIR --out DIR [--check]
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__.split("\n")[0])
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    for name in ("run", "plan"):
        c = commands.add_parser(name)
        c.add_argument("query")
        c.add_argument("--tables", required=True, help="folder of the Parquet tables")
        if name == "run":
            c.add_argument("--out", help="folder to write Parquet to; else rows are printed")
            c.add_argument("--limit", type=int, default=20, help="rows printed")
    c = commands.add_parser("build")
    c.add_argument("--snippets", required=True, help="folder of JSON lines")
    c.add_argument("--out", required=True)
    c.add_argument("--check", action="store_true", help="check labels first")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .plans import catalogue

    queries = catalogue.queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if args.command != "build" and args.query not in queries:
        print(f"unknown query {args.query!r}; see `list`", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .sources import reports, tables

    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if args.command == "build":
        from .operators import corpus

        rows = tables.load_snippets(spark, args.snippets)
        key = F.xxhash64("repo", "commit", "path", "start_line", "end_line")
        dataset, reasons = corpus.build(rows.withColumn("doc_id", key), check=args.check)
        tables.save_dataset(dataset, args.out)
        print(reports.markdown(tables.manifest(tables.load_dataset(spark, args.out)).counts.orderBy("split", "language")))
        print(reports.markdown(reasons.orderBy("reason")))
        return 0
    df = queries[args.query](spark, args.tables)
    if args.command == "plan":
        df.explain("formatted")
    elif args.out:
        df.write.mode("errorifexists").parquet(args.out)
    else:
        print(reports.markdown(df, args.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
