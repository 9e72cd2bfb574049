"""What a program calls: scans of a file or folder as findings, their statistics, and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .operators import scan, stats
from .plans import report
from .sources.files import read_tree


def scan_file(spark: SparkSession, path: str, kind: str = "secrets", **options) -> DataFrame:
    """Findings of one file; a file that isn't there has none. kind: secrets, llm, devsecops, all or entropy; options as for run_scan()."""
    if "://" not in path and not os.path.isfile(path):
        return spark.createDataFrame([], scan.FINDING)
    if kind == "entropy":
        return scan.scan_entropy(read_tree(spark, path), **options)
    return scan.run_scan(read_tree(spark, path), kind, directory=False, **options)


def scan_directory(spark: SparkSession, root: str, kind: str = "secrets", **options) -> DataFrame:
    """Findings of all files below a folder; FileNotFoundError if there is no such folder."""
    if kind == "entropy":
        return scan.scan_entropy(read_tree(spark, root, prune=False, relative=False), **options)
    return scan.run_scan(read_tree(spark, root), kind, **options)


def findings_of(found: DataFrame) -> dict[str, list]:
    """The findings of one file as {rule: matches}, in catalogue order; {} if there are none."""
    out: dict[str, list] = {}
    for r in found.orderBy("scanner", "rule_ord", "match_ord").collect():  # a file's, bounded by the size that is scanned
        out.setdefault(r.rule, []).append(tuple(r.parts) if r.parts is not None else r.match)
    return out


def get_scan_stats(found: DataFrame) -> dict[str, int]:
    return stats.scan_stats(found).first().asDict()


def _writer(kind: str):
    def to(found: DataFrame, path: str = f"vigilspark_report.{kind}", **options) -> str:
        return report.write(found, kind, path, **options)

    to.__doc__ = f"Writes the {kind} report of findings; returns where."
    return to


to_json, to_markdown, to_xml, to_sarif, to_html = map(_writer, ("json", "md", "xml", "sarif", "html"))


def generate_report(found: DataFrame, kind: str, **options) -> str:
    """A report as a string: the short form of json, md and xml, else the full one."""
    return report.generate_short(found, kind, **options) if kind.lower() in ("json", "md", "xml") else report.generate(found, kind, **options)
