"""Scans as one projection over files: every rule is a literal regular expression behind a test for a string that its matches must have.

findings: (path, scanner, rule, rule_ord, match_ord, match, parts); parts holds the groups of a match where a rule
reports several, else it is null. No scan shuffles, and severities prune rules before any text is looked at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..sources import files as S

FINDING = "path string, scanner string, rule string, rule_ord int, match_ord int, match string, parts array<string>"


def _glob(glob: str) -> Column:
    """A file name against a glob of literals and stars."""
    if "*" not in glob and "?" not in glob and "[" not in glob:
        return F.col("name") == glob
    if glob.startswith("*") and not set(glob[1:]) & set("*?["):
        return F.col("name").endswith(glob[1:])
    pattern = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in glob)
    return F.col("name").rlike(f"(?s)^{pattern}$")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _matches(rule: R.Rule, flat: bool, text: str) -> tuple[Column, Column]:
    """Distinct matches in a column in order of appearance, and their groups (null unless a tuple is asked for)."""
    pattern, n = F.lit(R.native(rule)), rule.groups
    nothing = F.lit(None).cast("array<array<string>>")
    if n < 2:
        return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(n))), nothing
    groups = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(f"g{k}") for k in range(1, n + 1)])
    if flat:
        return F.array_distinct(F.transform(groups, lambda g: F.concat_ws(" ", *[g[f"g{k}"] for k in range(1, n + 1)]))), nothing
    tuples = F.array_distinct(F.transform(groups, lambda g: F.array(*[g[f"g{k}"] for k in range(1, n + 1)])))
    shown = F.transform(tuples, lambda t: F.concat(F.lit("('"), F.array_join(t, "', '"), F.lit("')")))
    return shown, tuples


def find(files: DataFrame, rules: tuple[R.Rule, ...], along: tuple[str, ...] = (), takes: dict[str, Column] | None = None) -> DataFrame:
    """files (path, name, content) -> findings of the rules; null contents have none. Rules of several groups join them by a space, but those of the secrets scanner keep them apart. along: columns of files that come along. takes: the files that the rules of each scanner look at, all where it is left out.

    What many rules ask of a file is looked up once: its lower case, signs, runs and the lines that rules of one line can
    match in; a rule asks for its files first and for its own strings last.
    """
    if not rules:
        return files.sparkSession.createDataFrame([], FINDING)
    if takes is not None:
        takes = {k: c for k, c in takes.items() if any(r.scanner == k for r in rules)}
        files = files.where(_any(list(takes.values())))
    taken = {k: f"~takes_{k}" for k in takes or ()}
    signs = {n: f"~sign_{k}" for k, n in enumerate(sorted({n for r in rules for n in r.needs if not r.lines}))}
    used = {g for r in rules for g in r.gate if g in R.RUNS and not r.lines}
    low = files.select("path", *along, "name", "content", F.lower("content").alias("low"), *[F.col("content").rlike(R.RUNS[g]).alias(g) for g in sorted(used)], *[takes[k].alias(a) for k, a in taken.items()]).where("content is not null")
    if any(r.lines for r in rules):
        low = low.withColumn("~lines", F.array_join(F.filter(F.split("content", "\n"), lambda x: x.rlike(R.LINES)), "\n"))
        low = low.withColumn("~lines_low", F.lower("~lines"))
    low = low.select("*", *[F.col("low").contains(n).alias(a) for n, a in signs.items()])
    hits = []
    for rule in rules:
        text, small = ("~lines", "~lines_low") if rule.lines else ("content", "low")
        shown, parts = _matches(rule, rule.scanner not in (R.SECRETS, R.CUSTOM), text)
        tests = [F.col(taken[rule.scanner])] if taken else []
        tests += [_any([_glob(g) for g in rule.globs])] if rule.globs else []
        tests += [F.col("~lines") != ""] if rule.lines else []
        tests += [_any([F.col(small).contains(n) if rule.lines else F.col(signs[n]) for n in rule.needs])] if rule.needs else []
        tests += [_any([F.col(small).contains(g) if g not in R.RUNS else F.col(g) for g in rule.gate])] if rule.gate and not (rule.lines and set(rule.gate) & set(R.RUNS)) else []
        tests += [F.col(text).rlike(R.native(rule))] if rule.groups > 1 else []  # each group is a pass of its own
        gate = reduce(lambda a, b: a & b, tests) if tests else None
        kept = (lambda c: c if gate is None else F.when(gate, c))  # noqa: B023
        hits.append(F.struct(F.lit(rule.scanner).alias("scanner"), F.lit(rule.name).alias("rule"), F.lit(rule.ord).alias("rule_ord"), kept(shown).alias("found"), kept(parts).alias("tuples")))
    rows = low.select("path", *along, F.explode(F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0)).alias("h"))
    each = rows.select("path", *along, "h.scanner", "h.rule", "h.rule_ord", "h.tuples", F.posexplode("h.found").alias("match_ord", "match"))
    return each.select("path", "scanner", "rule", "rule_ord", "match_ord", "match", F.get("tuples", F.col("match_ord")).alias("parts"), *along)


def _at_least(rules: tuple[R.Rule, ...], threshold: str | None, mode: str, below: bool = False) -> tuple[R.Rule, ...]:
    """Severity depends on the rule alone, so a threshold drops rules, not rows. below: the rules that it drops."""
    least = R.LEVELS.index(threshold.upper()) if threshold is not None and threshold.upper() in R.LEVELS else 0
    return tuple(r for r in rules if (R.LEVELS.index(r.severity if mode == "effective" else r.declared) < least) == below)


def scan_secrets(files: DataFrame, threshold: str | None = None, mode: str = "effective", below: bool = False) -> DataFrame:
    return find(files.where(S.takes_secrets()), _at_least(R.SECRET_RULES, threshold, mode, below))


def scan_llm(files: DataFrame, threshold: str | None = None, mode: str = "effective", below: bool = False) -> DataFrame:
    """Notebooks are scanned by the sources of their cells."""
    own = files.where(S.takes_llm())
    own = own.withColumn("content", F.when(F.col("suffix") == ".ipynb", S.notebook_text(F.col("content"))).otherwise(F.col("content")))
    return find(own, _at_least(R.LLM_RULES, threshold, mode, below))


def scan_devsecops(files: DataFrame, threshold: str | None = None, mode: str = "effective", directory: bool = True, below: bool = False) -> DataFrame:
    return find(files.where(S.takes_devsecops(directory)), _at_least(R.DEVSECOPS_RULES, threshold, mode, below))


def scan_all(files: DataFrame, threshold: str | None = None, mode: str = "effective", directory: bool = True, below: bool = False) -> DataFrame:
    """The findings of the three scanners in one pass; only notebooks are read again, for the sources of their cells."""
    rules = [r for k in (R.SECRETS, R.LLM, R.DEVSECOPS) for r in _at_least(R.RULES[k], threshold, mode, below)]
    notebook = F.col("suffix") == ".ipynb"
    found = find(files, tuple(rules), takes={R.SECRETS: S.takes_secrets(), R.LLM: S.takes_llm() & ~notebook, R.DEVSECOPS: S.takes_devsecops(directory)})
    return found.unionByName(scan_llm(files.where(notebook), threshold, mode, below)) if any(r.scanner == R.LLM for r in rules) else found


def scan_custom(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    return find(files.where(S.takes_secrets()), R.custom_rules(patterns))


# What an assignment of a secret looks like, and the ends of lines.
ASSIGNMENT = r"(?i)(?:password|secret|key|token|credential|api|auth|access|private|cert|seed)\s*(?:=|:)\s*[\"']([A-Za-z0-9+/=_\-]{20,200})[\"']"
LINE_ENDS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\u0085  ]"


def entropy_values(files: DataFrame, threshold: float = 4.5, least: int = 20, most: int = 200) -> DataFrame:
    """files (path, content) -> (path, pos, value, entropy, charset, line_number, context): assigned strings of high entropy, each value once in a file, at its first place."""
    rule = R.Rule("assignment", 0, "", ASSIGNMENT, "", "")
    quoted = F.col("content").contains('"') | F.col("content").contains("'")
    lines = files.where(quoted).select("path", F.posexplode(F.split("content", LINE_ENDS)).alias("line", "text"))
    hits = lines.where(F.col("text").contains('"') | F.col("text").contains("'")).select("path", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(R.native(rule)), F.lit(1))).alias("at", "value"))
    hits = hits.where(F.length("value").between(least, most) & T.likely_secret(F.col("value")))
    once = hits.groupBy("path", "value").agg(F.min(F.struct("line", "at", "text")).alias("f"))
    scored = once.select("path", "value", "f.*", T.shannon_entropy(F.col("value"), T.BASE64).alias("b64"), T.shannon_entropy(F.col("value"), T.HEX).alias("hex"))
    best = F.greatest("b64", "hex")
    shown = F.bround(best, 2)
    return scored.where(best >= threshold).select(
        "path", F.struct("line", "at").alias("pos"), T.cut_text(F.col("value"), 50).alias("value"), shown.alias("entropy"),
        F.when(F.col("b64") >= F.col("hex"), "base64").otherwise("hex").alias("charset"), (F.col("line") + 1).alias("line_number"),
        F.substring(F.regexp_replace("text", r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), 1, 100).alias("context"),
    )


def scan_entropy(files: DataFrame, threshold: float = 4.5, least: int = 20) -> DataFrame:
    """Findings of the one rule of high entropy. match_ord counts a file's hits in order."""
    hits = entropy_values(files.where(S.takes_entropy()), threshold, least)
    told = F.concat(F.lit("entropy="), F.col("entropy").cast("string"), F.lit(" charset="), F.col("charset"), F.lit(" line="), F.col("line_number").cast("string"), F.lit(": "), F.col("value"))
    per = hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", told.alias("match")))).alias("all"))
    each = per.select("path", F.posexplode("all").alias("match_ord", "m"))
    return each.select("path", F.lit(R.ENTROPY).alias("scanner"), F.lit(R.HIGH_ENTROPY).alias("rule"), F.lit(0).alias("rule_ord"), "match_ord", F.col("m.match").alias("match"), F.lit(None).cast("array<string>").alias("parts"))


def run_scan(files: DataFrame, kind: str = "secrets", entropy: bool = False, threshold: str | None = None, mode: str = "effective", custom: dict[str, str] | None = None, entropy_threshold: float = 4.5, entropy_least: int = 20, directory: bool = True, below: bool = False) -> DataFrame:
    """The findings of one scanner or of all, merged; entropy goes with secrets. below: of the rules that the threshold drops."""
    if kind not in ("secrets", "llm", "devsecops", "all"):
        raise ValueError(f"unknown scan type: {kind}")
    own = {"secrets": scan_secrets, "llm": scan_llm}.get(kind)
    found = [own(files, threshold, mode, below) if own else (scan_all if kind == "all" else scan_devsecops)(files, threshold, mode, directory, below)]
    if kind in ("secrets", "all") and ((threshold or "LOW").upper() in R.LEVELS[1:]) == below:  # entropy and custom rules are LOW
        if entropy:
            found.append(scan_entropy(files, entropy_threshold, entropy_least))
        if custom:
            found.append(scan_custom(files, custom))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merge(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Findings of both; where both have a rule of a file, extra's replace base's."""
    keys = extra.select("path", "rule").distinct()
    return base.join(keys, ["path", "rule"], "left_anti").select(extra.columns).unionByName(extra)


def merged(findings: DataFrame, scanners: tuple[str, ...]) -> DataFrame:
    """merge() of the findings of several scanners, one after the other, where one pass has them all: of those of a rule of a file the last scanner's stay."""
    last = F.array_position(F.array(*[F.lit(s) for s in scanners]), F.col("scanner"))
    rows = findings.select("*", last.alias("__at"), F.max(last).over(Window.partitionBy("path", "rule")).alias("__last"))
    return rows.where((F.col("__at") == F.col("__last")) | F.col("path").isNull() | F.col("rule").isNull()).drop("__at", "__last")


def at_least(findings: DataFrame, threshold: str | None, mode: str = "effective") -> DataFrame:
    """Findings of rules of at least that severity; for findings from elsewhere, as scans take the threshold themselves."""
    if threshold is None:
        return findings
    names = [r.name for rules in R.RULES.values() for r in rules]
    least = R.LEVELS.index(threshold.upper()) if threshold.upper() in R.LEVELS else 0
    return findings.where(T.level(T.severity(F.col("rule"), names, mode)) >= least)


def without_false_positives(findings: DataFrame) -> DataFrame:
    return findings.where(~T.likely_false_positive(F.col("match")))


def beyond(files: DataFrame, kind: str, threshold: str, mode: str = "effective") -> DataFrame:
    """What a scan finds that one of the same files at a threshold doesn't.

    Which rules a scan at a threshold has depends on the rules alone and no two of them have the same name, so by path,
    rule and match these are all findings of the other rules: the files are scanned for these once, without a join.
    """
    return run_scan(files, kind, threshold=threshold, mode=mode, below=True)


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that a baseline lacks, by path, rule and match; for findings from elsewhere, as beyond() compares two scans of the same files."""
    return findings.join(baseline.select("path", "rule", "match").distinct(), ["path", "rule", "match"], "left_anti").select(findings.columns)
