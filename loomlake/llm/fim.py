"""Fill-in-middle transformation by escaped marker injection, in SQL functions only.

A text is cut into units (a run of ASCII letters, or any other code point).  The
cut is made without an array of units:

1. the delimiter and the escape character are escaped in the text, each to an
   escape character and a digit, which the unit pattern takes as one unit;
2. ``regexp_replace`` appends the delimiter to each unit, so that the delimiters
   can be counted and the k-th one ends the k-th unit;
3. ``substring_index`` takes the units before, between and after two ranks;
4. the parts are unescaped and assembled with the markers of prefix, suffix and
   middle.

Everything runs in the scan of the texts: no shuffle, no Python worker, and
memory of a few times the longest text of a task.

Cases: a null text counts as empty, and an empty one stays plain.  A text that
contains a marker stays plain, so that every other output splits at its markers
without doubt.  Texts may hold the delimiter, the escape character and any
length of one unit.  A null id is hashed as the empty string; rows are
independent, so repeated ids and texts need nothing.  An empty table gives an
empty table.  Columns of the input whose names are among the new ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The markers of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Plain rows from this value of h3 % 100, suffix first below this value of h4 % 100.
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
#: Delimiter and escape character (control characters, rare in texts), and what stands for each in an escaped text.
DELIMITER, ESCAPE = "\x01", "\x02"
ESCAPED_DELIMITER, ESCAPED_ESCAPE = "\x021", "\x020"
#: A unit of an escaped text.
UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"


def escape(text: Column) -> Column:
    """The text without delimiters; every escape character that is left is followed by 0 or 1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(DELIMITER), F.lit(ESCAPED_DELIMITER))


def unescape(part: Column) -> Column:
    """The text of an escaped part, delimiters after units taken out first."""
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(part, F.lit(ESCAPED_DELIMITER), F.lit(DELIMITER)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def inject(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escape(text), UNIT, f"$0{DELIMITER}")


def units(marked: Column) -> Column:
    """Number of units of a marked text."""
    return F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))


def part(marked: Column, first: Column, last: Column) -> Column:
    """The text of the units first+1 to last (0 <= first <= last <= number of units)."""
    upto = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), k.cast("int"))
    return unescape(upto(upto(marked, last), first - last))


def draws(doc_id: Column, seed: str = "1") -> list[Column]:
    """The first four 8-digit groups of sha256(seed:doc_id) as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def has_marker(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1") -> DataFrame:
    """All columns of ``docs`` with ``n`` (units), ``form`` (plain, psm, spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``."""
    new = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*kept, F.coalesce(docs[text], F.lit("")).alias("__text"), F.array(*draws(docs[key], seed)).alias("__h"))
    rows = rows.withColumn("__marked", inject(F.col("__text"))).withColumn("n", units(F.col("__marked")).cast("long"))
    at = [F.col("__h")[k] % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("__text") == "") | has_marker(F.col("__text")) | (F.col("__h")[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("__h")[3] % 100 < SUFFIX_FIRST_BELOW, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "__a": F.least(*at), "__b": F.greatest(*at)})
    split = lambda a, b: F.when(F.col("form") != "plain", part(F.col("__marked"), a, b))
    rows = rows.withColumns({"prefix": split(F.lit(0), F.col("__a")), "middle": split(F.col("__a"), F.col("__b")), "suffix": split(F.col("__b"), F.col("n"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    return rows.withColumn("output", output).select(*kept, *new)


def restore(output: Column, form: Column) -> Column:
    """The text again, from nothing but an output and its form; each marker occurs once in an output that is not plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
