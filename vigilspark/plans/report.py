"""Reports: a row for each file, made by the executors, and writers that put a head and a foot around them on the driver."""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats
from ..rules import LEVELS

TOOL, VERSION = "vigilspark", "0.1.0"
# Marks and colours of severities.
MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
COLOURS = {"CRITICAL": ("#dc3545", "#fff"), "HIGH": ("#fd7e14", "#fff"), "MEDIUM": ("#ffc107", "#212529"), "LOW": ("#28a745", "#fff")}


def _rules_of_files(findings: DataFrame) -> DataFrame:
    """(path, rules array<struct<rule_ord, rule, severity, n, matches, tuples>>), rules by scanner and catalogue order."""
    per = findings.groupBy("path", "scanner", "rule").agg(F.min("rule_ord").alias("rule_ord"), F.array_sort(F.collect_list(F.struct("match_ord", "match", "parts"))).alias("m"))
    order = F.when(F.col("scanner") == "secrets", 0).when(F.col("scanner") == "entropy", 1).when(F.col("scanner") == "llm", 2).when(F.col("scanner") == "devsecops", 3).otherwise(4)
    rows = stats.with_severity(per.select("path", order.alias("scanner_ord"), "rule_ord", "rule", F.col("m.match").alias("matches"), F.col("m.parts").alias("tuples")))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("scanner_ord", "rule_ord", "rule", "severity", "matches", "tuples"))).alias("rules"))


def _mark(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[severity]


def _badge(severity: Column) -> Column:
    styles = {s: f'<span class="badge" style="background:{b};color:{f}">{s}</span>' for s, (b, f) in COLOURS.items()}
    return F.create_map(*[F.lit(x) for kv in styles.items() for x in kv])[severity]


def _count(severity: str) -> Column:
    return F.size(F.filter("rules", lambda r: r["severity"] == severity))


def json_rows(findings: DataFrame) -> DataFrame:
    """(path, body): the JSON of a file's rules, matches of several groups as lists."""

    def value(r: Column) -> Column:
        one = F.to_json(F.struct(r["matches"].alias("matches"), r["severity"].alias("severity"), F.size(r["matches"]).alias("count")))
        many = F.to_json(F.struct(r["tuples"].alias("matches"), r["severity"].alias("severity"), F.size(r["matches"]).alias("count")))
        name = F.regexp_replace(F.to_json(F.array(r["rule"])), r"^\[|\]$", "")
        return F.concat(name, F.lit(": "), F.when(F.get(r["tuples"], F.lit(0)).isNotNull(), many).otherwise(one))

    return _rules_of_files(findings).select("path", F.concat(F.lit("{"), F.array_join(F.transform("rules", value), ", "), F.lit("}")).alias("body"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    def one(r: Column) -> Column:
        lines = F.transform(r["matches"], lambda m, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". `"), T.cut_text(m, 100), F.lit("`\n")))
        head = F.concat(F.lit("- "), _mark(r["severity"]), F.lit(" **"), r["rule"], F.lit("** ("), r["severity"], F.lit("): "), F.size(r["matches"]).cast("string"), F.lit(" match(es)\n"))
        return F.concat(head, F.array_join(lines, ""), F.lit("\n"))

    return _rules_of_files(findings).select("path", F.concat(F.lit("### 📄 `"), F.col("path"), F.lit("`\n\n"), F.array_join(F.transform("rules", one), "")).alias("body"))


def xml_rows(findings: DataFrame) -> DataFrame:
    def one(r: Column) -> Column:
        matches = F.transform(r["matches"], lambda m: F.concat(F.lit("        <Match>"), _xml(m), F.lit("</Match>\n")))
        return F.concat(F.lit('      <Category name="'), _xml(r["rule"]), F.lit('" severity="'), r["severity"], F.lit('" matchCount="'), F.size(r["matches"]).cast("string"), F.lit('">\n'), F.array_join(matches, ""), F.lit("      </Category>\n"))

    body = F.concat(F.lit('    <File path="'), _xml(F.col("path")), F.lit('" secretCount="'), F.size("rules").cast("string"), F.lit('">\n'), F.array_join(F.transform("rules", one), ""), F.lit("    </File>\n"))
    return _rules_of_files(findings).select("path", body.alias("body"))


def _xml(value: Column) -> Column:
    """Escaped, without the characters that XML has no way to write."""
    return T.escaped(F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�"))


def html_rows(findings: DataFrame) -> DataFrame:
    """Files by their base names, rules by name, ten matches each."""

    def one(r: Column) -> Column:
        matches = F.transform(F.slice(r["matches"], 1, 10), lambda m: F.concat(F.lit("<div class='match'>"), T.escaped(F.substring(m, 1, 200)), F.lit("</div>")))
        more = F.when(F.size(r["matches"]) > 10, F.concat(F.lit("<div class='match more'>... and "), (F.size(r["matches"]) - 10).cast("string"), F.lit(" more</div>"))).otherwise("")
        return F.concat(F.lit("<div class='pitem'><div class='pname'>"), T.escaped(r["rule"]), F.lit(" "), _badge(r["severity"]), F.lit("</div>"), F.array_join(matches, ""), more, F.lit("</div>"))

    by_name = F.array_sort("rules", lambda a, b: F.when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0))
    badges = [F.when(_count(s) > 0, F.concat(_badge(F.lit(s)), F.lit(" x"), _count(s).cast("string"))) for s in sorted(LEVELS)]
    head = F.concat(F.lit("<details><summary>"), T.escaped(F.element_at(F.split("path", "/"), -1)), F.lit(" "), F.concat_ws(" ", *badges), F.lit("</summary><div class='plist'>"))
    return _rules_of_files(findings).select("path", F.concat(head, F.array_join(F.transform(by_name, one), ""), F.lit("</div></details>")).alias("body"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """(path, rule, body): a result for each file and rule."""
    r = stats.sarif_results(findings)
    place = F.struct(F.struct(F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.lit(1).alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct("severity", F.col("match_count").alias("matchCount")).alias("properties"))
    return r.select(F.col("uri").alias("path"), F.col("rule_id").alias("rule"), F.to_json(body).alias("body"))


def _now(when: datetime.datetime | None) -> datetime.datetime:
    return when or datetime.datetime.now()


def _sum_up(findings: DataFrame) -> tuple[dict, dict]:
    s = stats.scan_stats(findings).first()
    levels = {r.severity: r.n for r in stats.severity_by_match(findings).collect()}
    return {"total_files": s.total_files, "total_secrets": s.total_secret_types, "total_matches": s.total_matches}, {k: levels[k] for k in reversed(LEVELS)}


def _bodies(rows: DataFrame) -> Iterator:
    """Row by row, in order, a partition at a time."""
    return rows.orderBy("path", *[c for c in rows.columns if c == "rule"]).toLocalIterator()


def lines(findings: DataFrame, kind: str, when: datetime.datetime | None = None, scan_type: str = "secrets") -> Iterator[str]:
    """The pieces of a report in one of five formats."""
    kind, now = kind.lower(), _now(when)
    if kind not in ("json", "md", "xml", "sarif", "html"):
        raise ValueError(f"Unknown report format: {kind}")
    if kind == "sarif":
        rules = [{"id": r.id, "name": r.name, "shortDescription": {"text": r.id}, "fullDescription": {"text": r.description}, "defaultConfiguration": {"level": r.level}, "properties": {"tags": ["security", r.tag], "security-severity": r.score}} for r in stats.sarif_rules(findings).orderBy("id").collect()]
        driver = {"name": TOOL, "version": VERSION, "rules": rules}
        yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + json.dumps(driver) + '}, "results": ['
        for k, r in enumerate(_bodies(sarif_rows(findings))):
            yield (",\n" if k else "\n") + r.body
        yield f'], "invocations": [{{"executionSuccessful": true, "startTimeUtc": "{now:%Y-%m-%dT%H:%M:%SZ}"}}]}}]}}'
        return
    total, levels = _sum_up(findings)
    if kind == "json":
        head = {"metadata": {"timestamp": now.isoformat(), "version": VERSION, "tool": TOOL}, "summary": total | {"severity_counts": levels}}
        yield json.dumps(head, indent=4)[:-2] + ',\n    "findings": {'
        for k, r in enumerate(_bodies(json_rows(findings))):
            yield (",\n" if k else "\n") + json.dumps(r.path, ensure_ascii=False) + ": " + r.body
        yield "\n    }\n}\n"
    elif kind == "md":
        yield f"# 🔍 Secret Scan Report\n\n**Generated:** {now.isoformat()}  \n**Tool:** {TOOL} v{VERSION}  \n\n## 📊 Summary\n\n- **Files Scanned:** {total['total_files']}\n- **Secret Types Found:** {total['total_secrets']}\n- **Total Matches:** {total['total_matches']}\n\n### 🚨 Severity Breakdown\n\n"
        yield "".join(f"- {MARKS[s]} **{s}:** {n}\n" for s, n in levels.items() if n) + "\n## 🔎 Detailed Findings\n\n"
        yield from (r.body for r in _bodies(markdown_rows(findings)))
    elif kind == "xml":
        yield f"<?xml version='1.0' encoding='utf-8'?>\n<SecretScanReport timestamp={quoteattr(now.isoformat())} version={quoteattr(VERSION)} tool={quoteattr(TOOL)}>\n"
        yield f'  <Summary totalFiles="{total["total_files"]}" totalSecrets="{total["total_secrets"]}" totalMatches="{total["total_matches"]}">\n    <SeverityCounts>\n' + "".join(f'      <Severity level="{s}" count="{n}" />\n' for s, n in levels.items()) + "    </SeverityCounts>\n  </Summary>\n  <Findings>\n"
        yield from (r.body for r in _bodies(xml_rows(findings)))
        yield "  </Findings>\n</SecretScanReport>\n"
    else:
        pairs = {r.severity: r.n for r in stats.severity_by_pair(findings).collect()}
        yield f"<!DOCTYPE html><html lang='en'><head><meta charset='UTF-8'><title>{TOOL} Security Report</title><style>.badge{{padding:2px 8px;border-radius:4px}}.match{{font-family:monospace}}.card{{display:inline-block;padding:16px}}</style></head><body><div class='container'><header><h1>{TOOL} Security Report</h1><div class='meta'>v{VERSION} &bull; {scan_type} &bull; {now:%Y-%m-%d %H:%M} UTC</div></header><div class='grid'>"
        for n, label in ((total["total_files"], "Files"), (total["total_secrets"], "Patterns"), *((pairs[s], s.title()) for s in reversed(LEVELS))):
            yield f"<div class='card'><div class='num'>{n}</div><div class='lbl'>{label}</div></div>"
        yield "</div>"
        if not total["total_files"]:
            yield "<div class='empty'>No security findings detected.</div>"
        yield from (r.body for r in _bodies(html_rows(findings)))
        yield "</div></body></html>"


def generate(findings: DataFrame, kind: str, **options) -> str:
    return "".join(lines(findings, kind, **options))


def write(findings: DataFrame, kind: str, path: str, **options) -> str:
    pieces = lines(findings, kind, **options)
    first = next(pieces)
    with open(path, "w", encoding="utf-8") as f:
        f.write(first)
        f.writelines(pieces)
    return path


def short_lines(findings: DataFrame, kind: str, when: datetime.datetime | None = None) -> Iterator[str]:
    """The pieces of a string report: JSON without severity counts, compact Markdown, XML without summary and wrapper."""
    kind, now = kind.lower(), _now(when).isoformat()
    if kind not in ("json", "md", "xml"):
        raise ValueError(f"Unknown report format: {kind}")
    rows = _bodies(_rules_of_files(findings))
    if kind == "json":
        s = stats.scan_stats(findings).first()
        head = {"metadata": {"timestamp": now, "version": VERSION, "tool": TOOL}, "summary": {"total_files": s.total_files, "total_secrets": s.total_secret_types, "total_matches": s.total_matches}}
        yield json.dumps(head, indent=2)[:-2] + ',\n  "findings": {'
        k = -1
        for k, f in enumerate(rows):
            one = {f.path: {r.rule: {"matches": _matches(r), "severity": r.severity, "count": len(r.matches)} for r in f.rules}}
            body = json.dumps(one, indent=2, ensure_ascii=False)[2:-2]
            yield (",\n" if k else "\n") + "\n".join("  " + x for x in body.split("\n"))
        yield ("}" if k < 0 else "\n  }") + "\n}"
    elif kind == "md":
        yield f"# 🔍 Secret Scan Report\n\n**Generated:** {now}\n"
        for f in rows:
            yield f"\n## 📄 {f.path}" + "".join(f"\n- {MARKS[r.severity]} **{r.rule}** ({r.severity}): {_matches(r)}" for r in f.rules)
    else:
        yield f"<SecretScanReport timestamp={quoteattr(now)} version={quoteattr(VERSION)}"
        k = -1
        for k, f in enumerate(rows):
            file = ET.Element("File", path=_writable(f.path))
            for r in f.rules:
                category = ET.SubElement(file, "Category", name=r.rule, severity=r.severity)
                for m in r.matches:
                    ET.SubElement(category, "Match").text = _writable(m)
            ET.indent(file, "  ", level=1)
            yield ("" if k else ">") + "\n  " + ET.tostring(file, encoding="unicode")
        yield " />" if k < 0 else "\n</SecretScanReport>"


def _matches(rule) -> list:
    """A rule's matches, those of several groups as tuples."""
    return [tuple(t) for t in rule.tuples] if rule.tuples[0] is not None else rule.matches


def _writable(text: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�", text)


def generate_short(findings: DataFrame, kind: str, **options) -> str:
    return "".join(short_lines(findings, kind, **options))
