"""Scalar functions as Columns: severity tables, cut-offs, JavaScript-like rounding, text measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The severity tables of the different reports.
PRIORITY = {"CRITICAL": 100, "HIGH": 50, "MEDIUM": 20, "LOW": 5}
PENALTY = {"CRITICAL": 10.0, "HIGH": 5.0, "MEDIUM": 2.0, "LOW": 0.5}
RANK = {"CRITICAL": 8, "HIGH": 5, "MEDIUM": 3, "LOW": 1, "INFO": 0}
RISK = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.45, "LOW": 0.2, "INFO": 0.1}
DEBT_MINUTES = {"CRITICAL": 120, "HIGH": 60, "MEDIUM": 30, "LOW": 15, "INFO": 5}
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
LANGUAGES = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "java": "java", "php": "php", "cs": "csharp", "rb": "ruby"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_severity(severity: Column | str, table: dict, default=None) -> Column:
    """The value of a severity in one of the tables; unknown and null severities have ``default``."""
    s, out = F.upper(_col(severity)), F.lit(default)
    for name, value in table.items():
        out = F.when(s == name, F.lit(value)).otherwise(out)
    return out


def grade(score: Column | str) -> Column:
    """A from 90, B from 80, C from 70, D from 60, else F."""
    s = _col(score)
    return F.when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def round_half_up(x: Column | str, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, also below zero."""
    scale = float(10**digits)
    return F.floor(_col(x) * scale + 0.5) / scale


def shannon_entropy(text: Column | str) -> Column:
    """Bits per character, in one expression; 0 for an empty text, null for null.

    Each distinct character is counted by what is left without it, so that long texts cost a pass per character.
    """
    t = _col(text)
    n = F.length(t).cast("double")
    shares = F.transform(F.filter(F.array_distinct(F.split(t, "")), lambda c: c != ""), lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
    return F.when(t.isNull(), None).otherwise(F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0)))


def language_of(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for name, lang in LANGUAGES.items():
        out = F.when(ext == name, lang).otherwise(out)
    return out


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extname(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)


def dirname(path: Column | str) -> Column:
    d = F.regexp_extract(_col(path), "^(.*)/", 1)
    return F.when(d == "", ".").otherwise(d)


def path_pattern(path: Column | str) -> Column:
    """``dir/*.ext``"""
    return F.concat(dirname(path), F.lit("/*"), extname(path))


def millis_of_range(text: Column | str, default: int = 7 * 86_400_000) -> Column:
    """Milliseconds of "7d", "12h", "30m"; ``default`` for anything else."""
    t = _col(text)
    n = F.regexp_extract(t, r"^(\d+)[dhm]$", 1).try_cast("long")
    unit = F.regexp_extract(t, r"^\d+([dhm])$", 1)
    return F.coalesce(n * F.when(unit == "d", 86_400_000).when(unit == "h", 3_600_000).when(unit == "m", 60_000), F.lit(default))


def error_type(message: Column | str) -> Column:
    m = F.regexp_extract(_col(message), r"^([A-Za-z]+(?:Error|Exception))", 1)
    return F.when(m == "", "UnknownError").otherwise(m)


def glob_regex(pattern: str) -> str:
    """``*`` within a segment, ``**`` across; everything else, ``?`` too, is literal.  A plain path also covers what is below it."""
    import re

    body = "".join("[^/]*" if p == "*" else ".*" if p == "**" else re.escape(p) for p in re.split(r"(\*\*|\*)", pattern.strip().strip("/")))
    return rf"(^|/){body}(/.*)?$"


def metavariable_regex(pattern: str) -> str:
    """A code pattern as a regular expression: ``$X`` is a dotted name, ``...`` anything (least), blanks are loose."""
    import re

    parts = re.split(r"(\$[A-Z_][A-Z0-9_]*|\.\.\.|\s+)", pattern.strip())
    return "".join(r"([\w.]+)" if p.startswith("$") and len(p) > 1 else ".*?" if p == "..." else r"\s*" if p.isspace() else re.escape(p) for p in parts)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    a, b = _col(a), _col(b)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def clean_version(version: Column | str) -> Column:
    """Strips one range operator."""
    return F.regexp_replace(_col(version), r"^[\^~>=<]", "")
