"""The command line: ``python -m millrace.cli INPUT --config FILE``."""

from __future__ import annotations

import argparse
import sys

from millrace.config import ConfigError, OcrUnavailableError, OutputWriteError
from millrace.plans.run import RunArgs, run
from millrace.sinks.report import render

#: What precedes a message of each kind of error.
PREFIXES = {ConfigError: "Configuration error", OcrUnavailableError: "OCR unavailable", OutputWriteError: "Write error"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description="Keep ledgers from bank statements and the documents that belong to them.")
    p.add_argument("input_path", help="folder that is scanned with all folders below it")
    p.add_argument("--config", default="millrace.yaml", metavar="PATH", help="configuration file (default: %(default)s)")
    p.add_argument("--output-dir", metavar="PATH", help="where workbooks and the archive go (default: INPUT/ledgers)")
    p.add_argument("--format", choices=("xlsx", "ods"), default="xlsx", help="kind of workbook (default: %(default)s)")
    p.add_argument("--dry-run", action="store_true", help="parse, match and report, but write nothing")
    p.add_argument("--review-once", action="store_true", help="don't repeat notes that the review holds already")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if the run succeeded, 1 for errors of the configuration, the environment or the output."""
    a = parser().parse_args(argv)
    try:
        from millrace.session import session

        report = run(session(), RunArgs(a.input_path, a.config, a.output_dir, a.format, a.dry_run, review_once=a.review_once))
    except tuple(PREFIXES) as e:
        print(f"{PREFIXES[type(e)]}: {e}", file=sys.stderr)
        return 1
    print(render(report, a.dry_run))
    return 0


if __name__ == "__main__":
    sys.exit(main())
