"""Command line: ``python -m clicktide session|pageflow|ads ...``."""

from __future__ import annotations

import argparse

from clicktide.operators.ads import CLICK_LIMIT
from clicktide.plans import jobs
from clicktide.session import build_session
from clicktide.sources.readers import read_kafka_lines, read_text_stream


def main() -> None:
    parser = argparse.ArgumentParser(prog="clicktide")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("session", "pageflow"):
        sub = commands.add_parser(name)
        sub.add_argument("--task-id", type=int, required=True)
        sub.add_argument("--tables", required=True, help="folder of the input tables")
        sub.add_argument("--results", required=True, help="folder of the result tables")
        if name == "session":
            sub.add_argument("--sample-total", type=int, default=100)
            sub.add_argument("--seed", default="0")
    sub = commands.add_parser("ads")
    sub.add_argument("--tables", required=True, help="folder of the maintained tables")
    sub.add_argument("--threshold", type=int, default=CLICK_LIMIT)
    sub.add_argument("--keep", help="close a day this long after its end, such as '2 days'; default: never")
    sub.add_argument("--interval", default="5 seconds")
    source = sub.add_mutually_exclusive_group(required=True)
    source.add_argument("--text", help="folder where text files arrive")
    source.add_argument("--kafka", nargs=2, metavar=("SERVERS", "TOPIC"))
    args = parser.parse_args()

    spark = build_session(f"clicktide-{args.command}")
    if args.command == "session":
        jobs.run_session_job(
            spark, args.tables, args.results, args.task_id, args.sample_total, args.seed
        )
    elif args.command == "pageflow":
        jobs.run_page_flow_job(spark, args.tables, args.results, args.task_id)
    else:
        lines = (
            read_text_stream(spark, args.text) if args.text else read_kafka_lines(spark, *args.kafka)
        )
        jobs.run_ad_stream_job(
            spark, lines, args.tables, args.threshold, args.keep, args.interval
        )


if __name__ == "__main__":
    main()
