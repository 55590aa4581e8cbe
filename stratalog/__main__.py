"""Command line: list or run registered queries, run a seed campaign, check or draw results."""

from __future__ import annotations

import argparse
import sys


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalog", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    q = sub.add_parser("query", help="run a query and show or write its rows")
    q.add_argument("name")
    q.add_argument("--data", required=True, help="folder with the Parquet tables")
    q.add_argument("--out", help="write Parquet here instead of showing rows")
    c = sub.add_parser("campaign", help="run a seed campaign")
    c.add_argument("--seeds", type=positive, default=100)
    v = sub.add_parser("validate", help="check a family of benchmark rows (JSON lines)")
    v.add_argument("family", choices=["write_throughput", "point_read", "bloom", "amplification", "compaction_pause", "skiplist"])
    v.add_argument("path")
    v.add_argument("--profile", choices=["smoke-v1", "report-v1"], default="report-v1")
    g = sub.add_parser("chart", help="draw write throughput by threshold from JSON lines")
    g.add_argument("path")
    g.add_argument("out")
    return p


def main(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    from .plans import catalog

    if args.command == "list":
        print("\n".join(catalog.queries()))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("stratalog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        rows = catalog.queries()[args.name](spark, args.data)
        rows.write.parquet(args.out) if args.out else rows.show(50, False)
        return 0
    if args.command == "campaign":
        from .plans import campaign

        total = campaign.aggregate(campaign.summaries(spark, args.seeds)).first().asDict()
        print(total)
        return int(total["failed"] > 0)
    from .operators import benchmarks
    from .sources import documents

    if args.command == "validate":
        rules = {
            "write_throughput": benchmarks.write_violations, "point_read": benchmarks.point_read_violations, "bloom": benchmarks.bloom_violations,
            "amplification": benchmarks.amplification_violations, "compaction_pause": benchmarks.pause_violations, "skiplist": benchmarks.skiplist_violations,
        }
        found = rules[args.family](documents.read_bench(spark, args.path, args.family), benchmarks.PROFILES[args.profile])
        found.show(100, False)
        return int(not found.isEmpty())
    from .plans import charts

    rows = benchmarks.throughput(documents.read_bench(spark, args.path, "write_throughput"))
    with open(args.out, "w") as f:
        f.write(charts.chart(rows, "flush_threshold_bytes", "median", None, "Operations a second"))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
