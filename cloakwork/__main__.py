"""python -m cloakwork redact|inspect IN [OUT]: a parquet table with doc_id and text, on this machine."""

from __future__ import annotations

import argparse

from cloakwork.functions.patterns import Registry
from cloakwork.operators.detect import deduplicated, detect, gated, masked, rescored
from cloakwork.session import local_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="cloakwork")
    commands = parser.add_subparsers(dest="command", required=True)
    redact = commands.add_parser("redact", help="write the table with its texts masked")
    redact.add_argument("input")
    redact.add_argument("output")
    redact.add_argument("--style", choices=("type", "block", "drop"), default="type")
    inspect = commands.add_parser("inspect", help="show what would be masked, by type")
    inspect.add_argument("input")
    for command in (redact, inspect):
        command.add_argument("--min-confidence", type=float, default=0.60)
    args = parser.parse_args()
    spark = local_session()
    docs = spark.read.parquet(args.input)
    if args.command == "redact":
        masked(docs, least=args.min_confidence, style=args.style).write.mode("overwrite").parquet(args.output)
    else:
        found = detect(docs, registry=Registry(), keep=("doc_id", "text"))
        found = gated(rescored(found, found["text"]), args.min_confidence).drop("text")
        deduplicated(found, "doc_id").groupBy("entity_type").count().orderBy("entity_type").show(100, truncate=False)


if __name__ == "__main__":
    main()
