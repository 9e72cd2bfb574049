"""Column functions of the scanners: entropy, likely secrets, likely false positives, severities, cut and escaped texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import FALSE_POSITIVES, LEVELS, severity_of

# Charsets and words of the entropy detector.
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="
HEX = "0123456789abcdefABCDEF"
PLACEHOLDERS = ("example", "placeholder", "changeme", "yourkey", "your_", "insert", "replace")
URL_STARTS = ("http://", "https://", "ftp://")


def shannon_entropy(value: Column, charset: str) -> Column:
    """Bits a character of value, of its characters in charset alone; 0 for fewer than eight of these."""
    kept = F.filter(F.split(value, ""), lambda c: (F.length(c) > 0) & F.contains(F.lit(charset), c))
    total = F.size(kept).cast("double")
    bits = F.aggregate(F.array_distinct(kept), F.lit(0.0), lambda acc, c: acc - (lambda p: p * F.log2(p))(F.size(F.filter(kept, lambda x: x == c)) / total))
    return F.when(total < 8, 0.0).otherwise(bits + F.lit(0.0))


def likely_secret(value: Column) -> Column:
    """Neither a URL nor a path of more than two slashes, and without a placeholder's word."""
    url = F.lit(False)
    for start in URL_STARTS:
        url = url | value.startswith(start)
    slashes = F.length(value) - F.length(F.replace(value, F.lit("/"), F.lit("")))
    return ~url & (slashes <= 2) & ~_has_any(value, PLACEHOLDERS)


def _has_any(value: Column, words) -> Column:
    low, out = F.lower(value), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def likely_false_positive(match: Column) -> Column:
    return F.when(match.startswith("eyJ") & match.contains("."), False).otherwise(_has_any(match, FALSE_POSITIVES))


def severity(rule: Column, names, mode: str = "effective") -> Column:
    """The severity of a rule by name; LOW for any that isn't among names."""
    known = [F.lit(x) for n in sorted(set(names)) if (s := severity_of(n, mode)) != "LOW" for x in (n, s)]
    return F.coalesce(F.create_map(*known)[rule], F.lit("LOW")) if known else F.lit("LOW")


def level(severity_: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, s in enumerate(LEVELS) for x in (s, k)])[severity_], F.lit(0))


def cut_text(value: Column, n: int) -> Column:
    return F.when(F.length(value) > n, F.concat(F.substring(value, 1, n), F.lit("..."))).otherwise(value)


def escaped(value: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def squeezed(name: Column) -> Column:
    """A rule's name without spaces, hyphens and slashes."""
    return F.translate(name, " -/", "")
