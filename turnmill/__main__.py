"""Command line: python -m turnmill import INPUT -o OUT [-f FORMAT] ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from turnmill.errors import EmptyResultError, ImportFormatError
from turnmill.operators.traces import PARSERS
from turnmill.plans.import_traces import import_files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="turnmill")
    commands = parser.add_subparsers(dest="command", required=True)
    imports = commands.add_parser("import", help="chat dumps to messages JSONL")
    imports.add_argument("input", nargs="+", help="files or folders")
    imports.add_argument("-o", "--out", required=True, help="output folder, must not exist")
    imports.add_argument("-f", "--format", choices=list(PARSERS), default="messages")
    imports.add_argument("--min-messages", type=int, default=2)
    imports.add_argument("--limit", type=int, default=None)
    imports.add_argument("--on-error", choices=["fail", "skip"], default="fail")
    imports.add_argument("--quarantine", default=None, help="folder for faulty lines, with --on-error skip")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    options = arguments(argv)
    spark = SparkSession.builder.appName("turnmill").getOrCreate()
    try:
        result = import_files(
            spark, options.input, options.out, options.format,
            options.min_messages, options.limit, options.on_error, quarantine=options.quarantine,
        )
    except (EmptyResultError, ImportFormatError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    report = f"{options.out}: {result.conversations} chats from {result.format} input"
    if result.skipped:
        report += f"; {result.skipped} faulty lines left out"
    print(report, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
