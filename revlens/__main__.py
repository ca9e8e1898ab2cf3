"""Command line.

    python -m revlens study --out OUT --scrape SCRAPE.csv \
        --file PATH:APP:SOURCE [--file ...] [--strict] [--split-files]
    python -m revlens report NAME --sf SF_DIR      # one named query, printed

The session comes from ``spark-submit`` when run there; locally a
``local[*]`` session is built.
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="revlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("study", help="raw CSV files -> gold, checks, results, BI tables")
    s.add_argument("--out", required=True)
    s.add_argument("--scrape", required=True)
    s.add_argument("--file", action="append", required=True, help="PATH:APP:SOURCE, priority order")
    s.add_argument("--strict", action="store_true")
    s.add_argument("--split-files", action="store_true", help="read each CSV by many tasks (RFC 4180 quoting only)")
    r = sub.add_parser("report", help="run one named query over a test-data folder")
    r.add_argument("name")
    r.add_argument("--sf", required=True)
    r.add_argument("--rows", type=int, default=50)
    a = ap.parse_args(argv)

    from revlens.session import get_spark
    spark = get_spark()
    if a.cmd == "study":
        from revlens.plans.study import run_study
        manifest = [tuple(x.rsplit(":", 2)) for x in a.file]
        paths = run_study(spark, manifest, a.scrape, a.out, strict=a.strict, split=a.split_files)
        for k, v in paths.items():
            print(f"{k:12s} {v}")
    else:
        from revlens.catalog import QUERIES
        QUERIES[a.name](spark, a.sf).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
