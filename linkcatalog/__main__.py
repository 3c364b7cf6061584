"""Command line: ``python -m linkcatalog list``, ``run NAME --dir FOLDER``, ``explain NAME --dir FOLDER``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkcatalog")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--dir", required=True, help="folder of the tables")
        p.add_argument("--limit", type=int, default=20)
        p.add_argument("--out", help="write Parquet here instead of showing rows")
    args = parser.parse_args(argv)
    from linkcatalog.plans import registry

    found = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if args.query not in found:
        parser.error(f"no query named {args.query}")
    from pyspark.sql import SparkSession

    df = found[args.query](SparkSession.builder.appName("linkcatalog").getOrCreate(), args.dir)
    if args.command == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
