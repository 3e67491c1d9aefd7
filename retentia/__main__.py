"""Command line: load extracts, list and run the named queries.

    python -m retentia load RAW_DIR CLEANED_DIR [--strict] [--versioned] [--database DB --order-buckets N]
    python -m retentia list
    python -m retentia run KEY (--sf-dir DIR | --cleaned-dir DIR [--database DB]) [--out PATH] [--show N]

``run`` executes one registered query on the test-data folder (``--sf-dir``)
or on a cleaned layer (``--cleaned-dir``); ``--out`` writes the result as CSV
(header, quoted values, NULL), ``--show`` prints the first N rows.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    from retentia.session import get_session
    return get_session()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="retentia")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="CSV extracts -> cleaned tables + constraint report")
    ld.add_argument("raw_dir")
    ld.add_argument("cleaned_dir")
    ld.add_argument("--strict", action="store_true")
    ld.add_argument("--database", help="also register the tables in this catalog database")
    ld.add_argument("--order-buckets", type=int, help="bucket the order-keyed tables by order_id")
    ld.add_argument("--versioned", action="store_true", help="write a new version of CLEANED_DIR, seen when it is complete")
    sub.add_parser("list", help="names of the registered queries")
    rn = sub.add_parser("run", help="run one registered query")
    rn.add_argument("key")
    src = rn.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir")
    src.add_argument("--cleaned-dir")
    rn.add_argument("--database", help="read cleaned tables from this catalog database if present")
    rn.add_argument("--out")
    rn.add_argument("--show", type=int, default=0)
    args = ap.parse_args(argv)

    from retentia.plans import registry
    if args.cmd == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = _session()
    if args.cmd == "load":
        from retentia.sources.warehouse import build_cleaned_layer, publish_cleaned_layer
        load = publish_cleaned_layer if args.versioned else build_cleaned_layer
        report = load(spark, args.raw_dir, args.cleaned_dir, strict=args.strict,
                      database=args.database, order_buckets=args.order_buckets)
        report.where("violations > 0").show(200, truncate=False)
        return 0
    from retentia.sources.roles import CleanedRoles, roles_for
    roles = (CleanedRoles(spark, args.cleaned_dir, args.database) if args.cleaned_dir
             else roles_for(spark, args.sf_dir))
    df = registry.run_on_roles(args.key, roles)
    if args.out:
        from retentia.sources.ingest import write_result_csv
        write_result_csv(df, args.out)
    if args.show:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
