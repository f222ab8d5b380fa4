"""Scalar functions over texts and addresses, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def skeleton(url: Column | str) -> Column:
    """An address without query and fragment, digits masked."""
    return F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), "[0-9]+", "#")


def without_tracking(url: Column | str) -> Column:
    """An address without utm parameters and fragment."""
    bare = F.regexp_replace(_c(url), r"#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"([?&])utm_[^&]*&?", "$1"), r"[?&]$", "")


def segments(url: Column | str) -> Column:
    """The path's non-empty segments."""
    path = F.regexp_replace(F.regexp_replace(_c(url), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda s: s != "")


def prefixes(items: Column, sep: str) -> Column:
    """All non-empty prefixes of an array, each joined by sep."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.array_join(F.slice(items, F.lit(1), i), sep))).otherwise(F.array().cast("array<string>"))


def stripped_reference(expr: Column | str) -> Column:
    """A reference without its address sign (and the parentheses after it), then one pointer sign, then enclosing parentheses."""
    bare = F.trim(_c(expr))
    for pattern in (r"^&(?:\(([\s\S]*)\)$|([\s\S]*))", r"^\*([\s\S]*)()", r"^\(([\s\S]*)\)$()"):
        bare = F.trim(F.regexp_replace(bare, pattern, "$1$2"))
    return bare


def masked_line(line: Column | str) -> Column:
    """A line with identifiers' numbers and quoted strings masked and white space collapsed."""
    s = F.regexp_replace(_c(line), r'"[^"]*"', '"S"')
    s = F.regexp_replace(s, r"[0-9]+", "N")
    return F.trim(F.regexp_replace(s, r"[ \t]+", " "))


def normal_line(line: Column | str, target: Column | None = None, stems: tuple[str, ...] = ("func_", "Root_", "Local_", r"\.f_", "Var")) -> Column:
    """A line for comparison: the target's text becomes one mark, the numbers after the stems N, and white space single blanks."""
    s = _c(line)
    if target is not None:
        s = F.when(target != "", F.replace(s, target, F.lit("__TARGET__"))).otherwise(s)
    return F.trim(F.regexp_replace(F.regexp_replace(s, rf"({'|'.join(stems)})[0-9]+", "$1N"), r"\s+", " "))


def anchors(line: Column | str) -> Column:
    """The distinct quoted strings of three characters or more and namespaced calls of a line, in order."""
    quoted = F.regexp_extract_all(_c(line), F.lit(r'"([^"]{3,})"'), F.lit(1))
    calls = F.regexp_extract_all(_c(line), F.lit(r"([A-Za-z_]+::[A-Za-z_]+)"), F.lit(1))
    return F.array_distinct(F.concat(quoted, calls))


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    """How many first characters two strings share."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def glob_to_regex(glob: str) -> str:
    """A shell glob as a regular expression for whole, lower-cased names."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in glob.lower())
    return f"^{out}$"


def natural_key(label: Column | str) -> Column:
    """All integers of a label as an array, (0) without any: arrays order element by element."""
    found = F.transform(F.regexp_extract_all(_c(label), F.lit(r"([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long")))


def proximity(a: Column, b: Column, steps: list[tuple[int, float]]) -> Column:
    """The bonus of the first step, by distance, that two numbers lie within; 0 beyond all."""
    d = F.abs(a - b)
    out = F.lit(0.0)
    for limit, bonus in sorted(steps, reverse=True):
        out = F.when(d <= limit, bonus).otherwise(out)
    return out
