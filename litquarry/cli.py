"""Command line: run the pipeline on a fixture or on the live services."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from litquarry.config import load_settings, load_topics
from litquarry.plans.pipeline import run_pipeline
from litquarry.session import materialise, release, ship_package
from litquarry.sources.fixture import load_fixture
from litquarry.sources.services import fetch_live


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Literature surveillance run")
    # The options of the command line and their defaults.
    parser.add_argument("--fixture", help="JSON array of normalised records")
    parser.add_argument("--live", action="store_true", help="read the live services")
    parser.add_argument("--topics", default="config/topics.json")
    parser.add_argument("--settings", default="config/settings.json")
    parser.add_argument("--out-dir", default="digests")
    parser.add_argument("--data-dir", default="data")
    parser.add_argument("--date", help="day the report is for; the services are always asked as of today")
    parser.add_argument("--per-query", type=int, default=10)
    parser.add_argument("--no-preprints", action="store_true")
    args = parser.parse_args(argv)
    if not (args.fixture or args.live):
        raise SystemExit("Name a source: --fixture FILE or --live.")
    spark = spark or SparkSession.builder.appName("litquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    topics = load_topics(args.topics)
    if args.fixture:
        papers = load_fixture(spark, args.fixture)
        fetched = papers.count()
    else:
        try:
            # written at once, so that the services are asked once
            papers = materialise(fetch_live(spark, topics, per_query=args.per_query, preprints=not args.no_preprints,
                                            api_key=os.environ.get("NCBI_API_KEY")), "fetched")
            fetched = papers.count()
        except Exception as e:
            print(f"ERROR: live fetch failed: {e}", file=sys.stderr)
            raise SystemExit(1) from e
        if not fetched:
            raise SystemExit("The services returned no records; check access and queries.")
    run = run_pipeline(papers, topics, load_settings(args.settings), args.out_dir, args.data_dir, args.date)
    print(run.report)
    print(f"\nQA: fetched={fetched} scored={run.ranked.count()} duplicates={run.duplicates.count()}")
    release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
