"""Text, path and typed-value functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_ws(s: Column) -> Column:
    """Every run of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def excerpt(s: Column, limit: int = 300) -> Column:
    """Trimmed, cut to a length with an ellipsis."""
    out = strip(s)
    return F.when(F.length(out) <= limit, out).otherwise(F.concat(F.regexp_replace(F.substring(out, 1, limit - 1), r"(?U)\s+\z", ""), F.lit("…")))


def visible(s: Column) -> Column:
    """Invisible characters as symbols; carriage returns first."""
    out = s
    for raw, shown in (("\r", "␍"), ("\n", "↵"), ("\t", "→"), (" ", "·")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def lines_kept(s: Column) -> Column:
    """Lines with their ends; the last may have none; no empty tail."""
    return F.regexp_extract_all(s, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of what two strings begin with alike, by bisection, so that long strings cost few comparisons."""
    n = F.least(F.length(a), F.length(b))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.ceil((s["lo"] + s["hi"]) / 2).cast("int")
        same = F.substring(a, 1, mid) == F.substring(b, 1, mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["lo"]


def line_text(line: Column) -> Column:
    """A line of lines_kept() without its end."""
    return F.regexp_replace(line, r"\r?\n\z", "")


def line_end(line: Column) -> Column:
    return F.regexp_extract(line, r"\r?\n\z", 0)


def line_kind(expected: Column, actual: Column, small_edits: Column) -> Column:
    """Why two lines of lines_kept() that differ do so; the first that fits. Their ends count only where the texts are equal.
    small_edits: at most two edits of three characters in all."""
    a, b, ea, eb = line_text(expected), line_text(actual), line_end(expected), line_end(actual)
    trimmed = lambda s: F.regexp_replace(s, r"(?U)\s+\z", "")
    squeezed = lambda s: F.regexp_replace(s, r"(?U)\s+", "")
    ends = F.when((F.length(ea) > 0) & (F.length(eb) > 0), "crlf").when(F.length(ea) > 0, "missing_newline").otherwise("extra_newline")
    return (
        F.when(a == b, ends).when(trimmed(a) == trimmed(b), "trailing_whitespace").when(F.lower(a) == F.lower(b), "case").when(squeezed(a) == squeezed(b), "whitespace")
        .when(small_edits, "typo").otherwise("different")
    )


# ---------------------------------------------------------------- paths


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def parents(p: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), n), "/")))


def path_order(p: Column) -> Column:
    """Sorts like a tree, case-insensitively, then by case."""
    return F.transform(F.split(p, "/"), lambda x: F.struct(F.lower(x).alias("lower"), x.alias("x")))


def unsafe_path(p: Column) -> Column:
    """Absolute, climbing, with a drive letter, or with a name that Windows reserves."""
    return p.rlike(r"^/") | p.rlike(r"^[A-Za-z]:") | p.rlike(r"(^|/)\.\.(/|$)") | p.rlike(r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)")


def redact_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"(?<=://)[^/@\s]+@", "***@")


def glob_regex(pattern: str) -> str | None:
    """A forbidden pattern as a regular expression on whole paths; None for blanks, comments and negations. Without an inner
    slash it is about names at any depth, with one about the path from the root; * and ? also match slashes there; sets in
    brackets, ! negating them; case counts."""
    import re

    core = pattern.strip()
    if not core or core[0] in "#!":
        return None
    core = core.rstrip("/").removeprefix("**/")
    anchored = "/" in core
    core, out, any_one = core.lstrip("/"), "", "." if anchored else "[^/]"
    while core:
        m = re.match(r"\[(!?\]?[^\]]*)\]", core)
        if m:
            inner = m[1].replace("\\", "\\\\").replace("]", "\\]").replace("[", "\\[").replace("&&", "&\\&")
            out += f"[^{inner[1:]}]" if inner.startswith("!") else f"[{inner}]".replace("[^", "[\\^")
            core = core[m.end() :]
        else:
            out += {"*": any_one + "*", "?": any_one}.get(core[0]) or re.sub(r"([^\w/])", r"\\\1", core[0])
            core = core[1:]
    return f"(?s)^{'' if anchored else '(.*/)?'}{out}$"


# ---------------------------------------------------------------- typed values


def values_match(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    """equal, close, int_for_float or different; booleans are no numbers, NaN equals nothing."""
    close = F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    numbers = kind_a.isin("int", "float") & kind_b.isin("int", "float")
    return (
        F.when(F.isnan(a) | F.isnan(b), "different")
        .when((kind_a == kind_b) & (a == b), "equal")
        .when((kind_a == "float") & (kind_b == "int") & close, "int_for_float")
        .when(numbers & (kind_a == kind_b) & (kind_a == "float") & close, "close")
        .otherwise("different")
    )
