"""Command line: scan a file or folder and write a report. Ends with 0 without findings, 1 with some, 2 after an error."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import config as C
from .operators import scan, stats
from .plans import report
from .rules import LEVELS
from .sources.files import read_tree


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="vigilspark", description="Scan files for secrets, risky LLM code and infrastructure misconfigurations.")
    p.add_argument("path")
    p.add_argument("--type", choices=C.SCAN_TYPES, default="secrets", dest="kind")
    p.add_argument("--format", choices=("json", "md", "xml", "sarif", "html"), default=os.environ.get("VIGILSPARK_REPORT_FORMAT", "md"))
    p.add_argument("--output", "-o")
    p.add_argument("--severity-threshold", choices=LEVELS)
    p.add_argument("--config")
    p.add_argument("--no-entropy", action="store_true")
    p.add_argument("--declared-severities", action="store_true", help="rate LLM and infrastructure rules as the catalogue declares them")
    p.add_argument("--verbose", "-v", action="store_true")
    return p.parse_args(argv)


def scan_path(spark: SparkSession, path: str, kind: str = "secrets", settings: C.Config | None = None, threshold: str | None = None, entropy: bool = True, mode: str = "effective"):
    """Findings of a file or folder. Entropy, if the settings enable it, goes over all folders, also those that other scans leave out, by the given path."""
    settings = settings or C.Config()
    single = os.path.isfile(path)
    files = read_tree(spark, path)
    found = scan.run_scan(files, kind, False, threshold, mode, directory=not single)
    if entropy and settings.entropy.enabled and kind in ("secrets", "all") and (threshold or "LOW") == "LOW":
        found = found.unionByName(scan.scan_entropy(read_tree(spark, path, prune=False, relative=False)))
    return found


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    settings = C.load(args.config, None if os.path.isfile(args.path) else args.path)
    threshold = args.severity_threshold or settings.severity_threshold
    spark = spark or SparkSession.builder.appName("vigilspark").getOrCreate()
    try:
        mode = "declared" if args.declared_severities else "effective"
        found = scan_path(spark, args.path, args.kind, settings, threshold, not args.no_entropy, mode).cache()
        total = stats.scan_stats(found).first()
        if not total.total_files:
            print("[+] No findings detected.")
            return 0
        written = report.write(found, args.format, args.output or f"vigilspark_report.{args.format}", scan_type=args.kind)
    except Exception as e:  # whatever it was, the exit code tells
        print(f"[!] Error during scan: {e}", file=sys.stderr)
        return 2
    if args.verbose:
        print(f"[*] {total.total_secret_types} finding(s) across {total.total_files} file(s)")
    print(f"[+] Report: {written}")
    return 1


if __name__ == "__main__":
    sys.exit(main())
