"""Text helpers as Column expressions, with Unicode classes spelt out so that engines agree."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, line ends, and words, for regex functions.
STRIP_RE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LINES_RE = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
WORD_RE = r"[\p{L}\p{N}_]+"
WORD_PY = re.compile(r"\w+")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP_RE, "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for each row, however often f uses it (also inside lambdas)."""
    return F.transform(F.array(value), f)[0]


def indices(n: Column) -> Column:
    """0 to n-1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(text: str) -> list[str]:
    """Lower-cased words of a query; repeats stay."""
    return WORD_PY.findall(text.lower())


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def round4(c: Column) -> Column:
    """Half up to four digits, alike in all engines."""
    return F.floor(c * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def slug(c: Column, fallback: str = "untitled", limit: int | None = None) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9äöüß\-\s]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"^-+|-+$", "")
    if limit:
        s = F.regexp_replace(F.substring(s, 1, limit), r"^-+|-+$", "")
    return F.when(s == "", F.lit(fallback)).otherwise(s)


def title_from_name(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"\.[^.]*$", ""), r"[\s_-]+", " "))
    return F.when(t == "", F.lit("untitled")).otherwise(t)


def preview(c: Column, width: int = 260) -> Column:
    t = collapse(c)
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, width - 1)), F.lit("…")))


def duration(seconds: Column) -> Column:
    """Seconds as days, hours, minutes and seconds, zero parts left out."""
    s = F.greatest(F.lit(0), F.bround(seconds, 0)).cast("long")
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    parts = F.concat_ws(" ", part(F.floor(s / 86400), "d"), part(F.floor(s % 86400 / 3600), "h"), part(F.floor(s % 3600 / 60), "m"), part(s % 60, "s"))
    return F.when(parts == "", F.lit("0s")).otherwise(parts)


def property_key(c: Column) -> Column:
    k = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("/", " ")):
        k = F.replace(k, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(k, r"[^a-z0-9\s_-]", ""), "[_-]", " "), r"\s+", " "))


def property_list(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def glob_to_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex; a star also crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def has_meaningful_content(body: Column) -> Column:
    """Whether any line is neither blank nor a heading."""
    lines = F.split(body, LINES_RE)
    return F.exists(lines, lambda x: (strip(x) != "") & ~strip(x).rlike(r"^#{1,6}(\s|$)"))
