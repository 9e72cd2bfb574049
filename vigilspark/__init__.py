"""A Spark-native engine that scans text corpora for secrets, risky language-model code and infrastructure misconfigurations."""

from . import rules
from .api import findings_of, generate_report, get_scan_stats, scan_directory, scan_file, to_html, to_json, to_markdown, to_sarif, to_xml

__version__ = "0.1.0"
__all__ = ["__version__", "findings_of", "generate_report", "get_scan_stats", "rules", "scan_directory", "scan_file", "to_html", "to_json", "to_markdown", "to_sarif", "to_xml"]
