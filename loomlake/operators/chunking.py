"""Chunkers: fixed windows, and Markdown sections merged and split by size. All row-wise, without a shuffle.

Work is in proportion to a text's length.  A text is cut once into blocks of a
window's step, and a window is a few neighbouring blocks; sections are slices of
the lines between two headings, and merged sections slices of the sections
between two large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import LINES_RE, indices, let, strip

#: Sizes of the two chunkers.
SIMPLE_SIZE, SIMPLE_OVERLAP = 1200, 150
MARKDOWN_MAX, MARKDOWN_MIN, MARKDOWN_OVERLAP = 1200, 200, 100


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<string> of overlapping windows; the i-th begins at i * (size - overlap), the last is the first to reach the end.

    A text that is not empty has one window at least.
    """
    step = size - overlap
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    more = F.sequence(F.lit(0), F.lit(-(-size // step) - 1))  # blocks that a window reaches into

    def cut(b: Column) -> Column:
        # all blocks but the last are full
        length = (F.size(b) - 1) * step + F.length(F.coalesce(F.get(b, F.size(b) - 1), F.lit("")))
        n = F.ceil(F.greatest(length - size, F.lit(0)) / F.lit(step)).cast("int") + 1
        return F.transform(indices(F.when(length > 0, n).otherwise(0)), lambda i: F.substring(F.array_join(F.transform(more, lambda k: F.get(b, i + k)), ""), 1, size))

    return let(blocks, cut)


def simple_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIMPLE_SIZE, overlap: int = SIMPLE_OVERLAP) -> DataFrame:
    """(key, chunk_id, chunk_index, chunk_start, chunk_end, text): overlapping windows of the stripped text; blank ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    rows = docs.select(F.col(key), F.posexplode(windows(strip(F.coalesce(F.col(text), F.lit(""))), size, overlap)).alias("chunk_index", "piece"))
    rows = rows.withColumn("chunk_start", (F.col("chunk_index") * (size - overlap)).cast("int"))
    rows = rows.select(key, F.format_string("%s-chunk-%04d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), "chunk_index", "chunk_start", (F.col("chunk_start") + F.length("piece")).alias("chunk_end"), strip(F.col("piece")).alias("text"))
    return rows.where("text <> ''")


def sections(body: Column) -> Column:
    """array<struct<header, level, content>>: a section begins at each heading; the text before the first has level 0."""
    level = lambda x: F.length(F.regexp_extract(x, "^(#+)", 1))

    def cut(lines: Column) -> Column:
        heads = F.filter(indices(F.size(lines)), lambda i: F.get(lines, i).rlike(r"^#{1,6}\s+"))
        # a section is what stands between two of these; before the first heading there is none, behind the last the end
        bounds = F.concat(F.array(F.lit(-1)), heads, F.array(F.size(lines)))
        return let(bounds, lambda b: F.transform(indices(F.size(b) - 1), lambda k: own(lines, F.get(b, k), F.get(b, k + 1))))

    def own(lines: Column, head: Column, end: Column) -> Column:
        said = F.coalesce(F.get(lines, head), F.lit(""))
        content = strip(F.array_join(F.slice(lines, head + 2, end - head - 1), "\n"))
        return F.struct(strip(F.regexp_replace(said, r"^#{1,6}\s+", "")).alias("header"), F.when(head >= 0, level(said)).otherwise(0).alias("level"), content.alias("content"))

    return F.filter(let(F.split(body, LINES_RE), cut), lambda s: (s["header"] != "") | (s["content"] != ""))


def render(section: Column) -> Column:
    head = F.concat(F.repeat(F.lit("#"), section["level"]), F.lit(" "), section["header"])
    return F.when(section["header"] == "", section["content"]).when(section["content"] == "", head).otherwise(F.concat(head, F.lit("\n"), section["content"]))


def merge_small(parts: Column, least: int = MARKDOWN_MIN) -> Column:
    """Joins each section that renders shorter than ``least`` to the one before; the first one stays.

    Rendered sections have no white space at their ends, so a run of short ones is joined at once.
    """

    def cut(p: Column, rendered: Column) -> Column:
        first = F.filter(indices(F.size(p)), lambda i: (i == 0) | (F.length(F.get(rendered, i)) >= least))
        return let(F.concat(first, F.array(F.size(p))), lambda b: F.transform(indices(F.size(b) - 1), lambda k: joined(p, rendered, F.get(b, k), F.get(b, k + 1))))

    def joined(p: Column, rendered: Column, at: Column, end: Column) -> Column:
        head = F.get(p, at)
        content = F.array_join(F.concat(F.array(F.when(head["content"] != "", head["content"])), F.slice(rendered, at + 2, end - at - 1)), "\n\n")
        return F.struct(head["header"].alias("header"), head["level"].alias("level"), content.alias("content"))

    return let(parts, lambda p: let(F.transform(p, render), lambda r: cut(p, r)))


def markdown_chunks(docs: DataFrame, key: str = "doc_id", body: str = "body", most: int = MARKDOWN_MAX, least: int = MARKDOWN_MIN, overlap: int = MARKDOWN_OVERLAP) -> DataFrame:
    """Chunks by section, small ones merged, large ones cut into windows; numbered densely within a document."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be smaller than the chunk size")
    rows = docs.select(key, F.posexplode(merge_small(sections(strip(F.coalesce(F.col(body), F.lit("")))), least)).alias("part", "s"))
    rows = rows.select(key, "part", F.col("s.header").alias("section_header"), F.col("s.level").alias("section_level"), render(F.col("s")).alias("whole")).where("whole <> ''")
    pieces = F.when(F.length("whole") <= most, F.array("whole")).otherwise(windows(F.col("whole"), most, overlap))
    rows = rows.select(key, "part", "section_header", "section_level", F.posexplode(pieces).alias("n", "piece"))
    rows = rows.select(key, "part", (F.col("n") * (most - overlap)).cast("int").alias("chunk_start"), "section_header", "section_level", strip(F.col("piece")).alias("text"))
    return rows.where("text <> ''")
