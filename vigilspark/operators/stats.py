"""Aggregates over findings: statistics, severities by match and by pair, numbered matches, and the rows that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T

_NAMES = [r.name for rules in R.RULES.values() for r in rules]
#: Levels and scores of the SARIF format.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
SARIF_SCORE = {"CRITICAL": "9.8", "HIGH": "7.5", "MEDIUM": "5.0", "LOW": "2.5"}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])[key]


def with_severity(findings: DataFrame, mode: str = "effective") -> DataFrame:
    return findings.withColumn("severity", T.severity(F.col("rule"), _NAMES, mode))


def pairs(findings: DataFrame) -> DataFrame:
    """(path, rule, severity, match_count): a row for each file and rule."""
    return with_severity(findings.groupBy("path", "rule").agg(F.count("*").alias("match_count")))


def scan_stats(findings: DataFrame) -> DataFrame:
    """One row: files with findings, pairs of file and rule, matches."""
    return pairs(findings).agg(F.countDistinct("path").alias("total_files"), F.count("*").alias("total_secret_types"), F.coalesce(F.sum("match_count"), F.lit(0)).alias("total_matches"))


def pattern_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule").agg(F.count("*").alias("matches"))


def _per_level(rows: DataFrame, n: Column) -> DataFrame:
    """All four levels, those without rows with 0."""
    levels = rows.sparkSession.createDataFrame([(s,) for s in R.LEVELS], "severity string")
    return F.broadcast(levels).join(rows.groupBy("severity").agg(n.alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def severity_by_match(findings: DataFrame, mode: str = "effective") -> DataFrame:
    return _per_level(with_severity(findings, mode), F.count("*"))


def severity_by_pair(findings: DataFrame) -> DataFrame:
    return _per_level(pairs(findings), F.count("*"))


def file_severities(findings: DataFrame) -> DataFrame:
    """(path, critical, high, medium, low): rules of each file by severity."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(R.LEVELS)]
    return pairs(findings).groupBy("path").agg(*counts)


def by_scanner(findings: DataFrame) -> DataFrame:
    """Matches by scanner, severity and rule, with all subtotals."""
    return with_severity(findings).rollup("scanner", "severity", "rule").agg(F.count("*").alias("matches"))


def numbered(findings: DataFrame, width: int = 100) -> DataFrame:
    """(path, rule, no, shown): matches from 1 in each file and rule, long ones cut."""
    w = Window.partitionBy("path", "rule").orderBy("match_ord")
    return findings.select("path", "rule", F.row_number().over(w).alias("no"), T.cut_text(F.col("match"), width).alias("shown"))


def first_ten(findings: DataFrame, most: int = 10, width: int = 200) -> DataFrame:
    """(path, rule, no, shown, more): the first matches, escaped, and how many more there are."""
    pair = Window.partitionBy("path", "rule")
    rows = findings.select("path", "rule", "match", F.row_number().over(pair.orderBy("match_ord")).alias("no"), F.count("*").over(pair).alias("n"))
    return rows.where(F.col("no") <= most).select("path", "rule", "no", T.escaped(F.substring("match", 1, width)).alias("shown"), F.greatest(F.col("n") - most, F.lit(0)).alias("more"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    rows = with_severity(findings.select("rule").distinct())
    return rows.select(F.col("rule").alias("id"), T.squeezed(F.col("rule")).alias("name"), F.concat(F.lit("Detected: "), F.col("rule")).alias("description"), _lookup(SARIF_LEVEL, F.col("severity")).alias("level"), F.lower("severity").alias("tag"), _lookup(SARIF_SCORE, F.col("severity")).alias("score"))


def sarif_results(findings: DataFrame) -> DataFrame:
    n = F.col("match_count")
    message = F.concat(F.col("rule"), F.lit(" ("), n.cast("string"), F.lit(" occurrence"), F.when(n == 1, "").otherwise("s"), F.lit(")"))
    return pairs(findings).select(F.col("rule").alias("rule_id"), _lookup(SARIF_LEVEL, F.col("severity")).alias("level"), message.alias("message"), F.replace("path", F.lit("\\"), F.lit("/")).alias("uri"), "severity", n)


def nested(findings: DataFrame) -> DataFrame:
    """(path, findings map<rule, array<match>>), a row for each file."""
    per = findings.groupBy("path", "rule").agg(F.array_sort(F.collect_list(F.struct("match_ord", "match"))).alias("m"), F.min("rule_ord").alias("o"))
    return per.groupBy("path").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("o", "rule", F.col("m.match").alias("match")))), lambda e: F.struct(e["rule"], e["match"]))).alias("findings"))
