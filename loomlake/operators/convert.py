"""Converting files to Markdown: routing by extension, converters of text formats, attachments of pages and issues.

A converter is a name, the extensions that it takes and a function from bytes to
Markdown.  The first that takes an extension gets the file.  Contents are read by
the tasks that convert them; a file that fails gives a row that says why.
Converters of office formats and PDF need third-party packages: pass your own.

A converter may say more than a text (``Converted``): warnings, a reference that
goes into the front matter of the page that the file hangs on, and further files
that are written beside that page.  One that works ``in_context`` is told which
page or issue it works for (``Parent``) and is called for each attachment; all
others are called once for each file, however many pages have it.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.functions.text import collapse
from loomlake.operators import markup
from loomlake.runtime import ensure_package
from loomlake.sources.readers import CONVERTED

c = F.col
#: Warnings of attachments, and of converted files; below SHORT characters a text is unusually short.
MISSING_PATH, NOT_FOUND, UNSUPPORTED = "attachment_missing_local_path", "attachment_file_not_found", "attachment_unsupported_extension"
FAILED, EMPTY, WARNED = "attachment_transform_failed", "attachment_empty_markdown", "attachment_transform_warning"
EMPTY_TEXT, SHORT_TEXT, SHORT = "Empty markdown output", "Markdown output is unusually short", 80
NO_NAME = "Anhang"


@dataclass(frozen=True)
class Parent:
    """What a file is attached to, as a converter in context is told."""

    name: str = ""
    local_path: str = ""
    system: str = ""
    id: str = ""
    title: str = ""
    source_ref: str = ""
    source_url: str = ""
    output_name: str = ""
    text: str = ""


@dataclass(frozen=True)
class Artifact:
    """A file that a converter wants written beside the page."""

    name: str
    media_type: str
    content: str


@dataclass(frozen=True)
class Converted:
    markdown: str
    warnings: tuple[str, ...] = ()
    reference: dict | None = None
    artifacts: tuple[Artifact, ...] = ()


@dataclass(frozen=True)
class Converter:
    name: str
    extensions: tuple[str, ...]
    convert: Callable[..., str | Converted]
    in_context: bool = False


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|").replace("\n", " ") for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if rows else ""


def from_csv(data: bytes) -> str:
    return _table([r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"))) if r])


def from_json(data: bytes) -> str:
    return f"```json\n{json.dumps(json.loads(data.decode('utf-8-sig')), ensure_ascii=False, indent=2)}\n```"


def from_xml(data: bytes) -> str:
    def lines(node: ElementTree.Element, depth: int) -> Iterator[str]:
        said = " ".join([*(f"{k}={v}" for k, v in node.attrib.items()), *((node.text or "").split())])
        yield f"{'  ' * depth}- {node.tag.rpartition('}')[2]}" + (f": {said}" if said else "")
        for child in node:
            yield from lines(child, depth + 1)

    return "\n".join(lines(ElementTree.fromstring(data), 0))


def from_html(data: bytes) -> str:
    return markup.to_markdown(data.decode("utf-8", "replace"))[0]


CONVERTERS = (Converter("csv", ("csv",), from_csv), Converter("json", ("json",), from_json), Converter("xml", ("xml", "xsd"), from_xml), Converter("html", ("html", "htm"), from_html))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def route(ext: Column, converters: tuple[Converter, ...] = CONVERTERS) -> Column:
    """Name of the first converter that takes an extension; null for none."""
    out = F.lit(None).cast("string")
    for conv in reversed(converters):
        out = F.when(ext.isin(*conv.extensions), F.lit(conv.name)).otherwise(out)
    return out


def can_convert(ext: Column) -> Column:
    """Whether an extension belongs to the formats that documents may have, with or without a converter here."""
    return ext.isin(CONVERTED)


def contents(spark: SparkSession, root: str, extensions: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, content, size, modified) of a tree's files, of some extensions only if given; with ``only`` (paths) no other file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = rows.option("pathGlobFilter", "*.{" + ",".join(sorted({x for e in extensions for x in (e, e.upper())})) + "}") if extensions else rows
    rows = rows.load(root)
    if only is not None:  # the scan prunes files by the encoded path; the plain one decides
        rows = rows.where(c("_metadata.file_path").isin(only + [spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString() for p in only])).where(c("path").isin(only))
    return rows.select("path", "content", c("length").alias("size"), c("modificationTime").alias("modified"))


ARTIFACTS = T.ArrayType(T.StructType([T.StructField(f.name, T.StringType()) for f in fields(Artifact)]))
PARENT = T.StructType([T.StructField(f.name, T.StringType()) for f in fields(Parent)])


def convert(files: DataFrame, converters: tuple[Converter, ...] = CONVERTERS, parent: str | None = None) -> DataFrame:
    """All columns of files (path, content) but the content, with transformer, markdown, sha256, success, error, notes, reference, artifacts and warnings.

    A file that no converter takes has a null transformer and no success. ``parent`` names a column (PARENT) with
    what converters in context are told; without it they are told nothing. Notes are the converter's own warnings,
    a reference is JSON.
    """
    ensure_package(files.sparkSession)
    new = [
        ("transformer", T.StringType()), ("markdown", T.StringType()), ("sha256", T.StringType()), ("success", T.BooleanType()), ("error", T.StringType()),
        ("notes", T.ArrayType(T.StringType())), ("reference", T.StringType()), ("artifacts", ARTIFACTS),
    ]
    kept = [f for f in files.schema.fields if f.name not in {"content", "__by", parent, *(n for n, _ in new)}]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in new)])
    by_name = {x.name: x for x in converters}

    def one(data: bytes, name: str | None, told: str | None) -> tuple:
        if not name:
            return "", False, None, [], None, []
        use = by_name[name]
        try:
            out = use.convert(data, Parent(**{k: v or "" for k, v in json.loads(told or "{}").items()})) if use.in_context else use.convert(data)
        except Exception as e:  # one file must not end the run; its row says why
            return "", False, f"{name} conversion failed: {e}", [], None, []
        out = out if isinstance(out, Converted) else Converted(out)
        reference = json.dumps(out.reference, ensure_ascii=False) if out.reference else None
        return out.markdown, True, None, list(out.warnings), reference, [{"name": a.name, "media_type": a.media_type, "content": a.content} for a in out.artifacts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [one(bytes(data or b""), name, told) for data, name, told in zip(batch["content"], batch["__by"], batch["__told"])]
            done = pd.DataFrame(out, columns=["markdown", "success", "error", "notes", "reference", "artifacts"])
            done["transformer"], done["sha256"] = batch["__by"].to_numpy(), batch["__hash"].to_numpy()
            yield pd.concat([batch[[f.name for f in kept]].reset_index(drop=True), done], axis=1)[schema.names]

    told = F.to_json(parent) if parent else F.lit(None).cast("string")
    frame = files.select(*[f.name for f in kept], "content", route(extension(c("path")), converters).alias("__by"), F.sha2("content", 256).alias("__hash"), told.alias("__told"))
    done = frame.mapInPandas(run, schema)
    length = F.length(F.trim(F.coalesce("markdown", F.lit(""))))
    return done.withColumn("warnings", F.concat("notes", F.array_compact(F.array(F.when(length == 0, EMPTY_TEXT).when(length < SHORT, SHORT_TEXT)))))


# ---------------------------------------------------------------- attachments


def suffix(name: Column, path: Column) -> Column:
    """Extension of an attachment with its dot, from its place or its name."""
    s = F.lower(F.regexp_extract(F.coalesce(F.when(F.trim(path) != "", F.trim(path)), name), r"[^/.](\.[^./]*)$", 1))
    return F.when(s == "", "<noext>").otherwise(s)


def parents(system: str, key: Column, title: Column, source_ref: Column, source_url: Column, output_name: Column, text: Column) -> Column:
    """What converters in context are told of the page or issue; name and place of the attachment are added for each."""
    told = {"name": F.lit(""), "local_path": F.lit(""), "system": F.lit(system), "id": key, "title": title, "source_ref": source_ref, "source_url": source_url, "output_name": output_name, "text": text}
    return F.struct(*[told[n].cast("string").alias(n) for n in PARENT.names])


def extract_attachments(rows: DataFrame, key: str, root: str, converters: tuple[Converter, ...] = CONVERTERS, parent: Column | None = None) -> DataFrame:
    """One row for each attachment of rows (key, attachments): key, pos, name, suffix, markdown, code and message of what went wrong,
    and of those that were converted notes, reference and artifacts.

    Files are read once by path, so an attachment of many pages is converted once; only converters in context
    are called for each page, with ``parent``.
    """
    spark = rows.sparkSession
    each = rows.select(key, F.posexplode("attachments").alias("pos", "a")).select(key, "pos", F.coalesce("a.name", F.lit(NO_NAME)).alias("name"), F.col("a.local_path").alias("local_path"))
    each = each.withColumns({"suffix": suffix(c("name"), c("local_path")), "place": F.regexp_replace("local_path", "^file:/*", "/")})
    files = contents(spark, root).withColumn("place", F.regexp_replace("path", "^file:/*", "/"))
    wanted = each.select("place").where("place IS NOT NULL").distinct()
    in_context = F.coalesce(route(extension(c("place")), converters).isin([x.name for x in converters if x.in_context]), F.lit(False))
    out = ["transformer", "markdown", "success", "error", "notes", "reference", "artifacts"]
    if not any(x.in_context for x in converters):
        done = each.join(convert(files.join(wanted, "place", "left_semi"), converters).select("place", *out), "place", "left")
    else:
        told = rows.select(key, (F.lit(None).cast(PARENT) if parent is None else parent).alias("__parent"))
        mine = each.where(in_context).join(told, key).withColumn("__parent", c("__parent").withField("name", c("name")).withField("local_path", c("place")))
        mine = files.join(mine.select(key, "pos", "place", "__parent"), "place")
        mine = each.where(in_context).join(convert(mine, converters, "__parent").select(key, "pos", *out), [key, "pos"], "left")
        others = each.where(~in_context)
        done = others.join(convert(files.where(~in_context).join(wanted, "place", "left_semi"), converters).select("place", *out), "place", "left")
        done = done.unionByName(mine.select(done.columns))
    code = (
        F.when(c("place").isNull(), MISSING_PATH).when(c("success").isNull(), NOT_FOUND).when(c("transformer").isNull(), UNSUPPORTED)
        .when(~c("success"), FAILED).when(F.trim("markdown") == "", EMPTY)
    )
    said = (
        F.when(code == MISSING_PATH, F.format_string("Anhang '%s' hat keinen auflösbaren lokalen Pfad.", "name")).when(code == NOT_FOUND, F.concat(F.lit("Anhang-Datei nicht gefunden: "), "local_path"))
        .when(code == UNSUPPORTED, F.format_string("Anhang '%s' hat nicht unterstützte Endung '%s'.", "name", "suffix")).when(code == FAILED, F.format_string("Anhang '%s' konnte nicht transformiert werden: %s", "name", "error"))
        .when(code == EMPTY, F.format_string("Anhang '%s' lieferte leeres Markdown.", "name"))
    )
    good = lambda x, none: F.when(code.isNull(), x).otherwise(none)
    return done.select(
        key, "pos", "name", "suffix", F.when(code.isNull(), F.trim("markdown")).alias("markdown"), code.alias("code"), said.alias("message"),
        good(c("notes"), F.array().cast("array<string>")).alias("notes"), good(c("reference"), F.lit(None)).alias("reference"), good(c("artifacts"), F.array().cast(ARTIFACTS)).alias("artifacts"),
    )


def attachment_sections(extracted: DataFrame, key: str) -> DataFrame:
    """(key, sections, warnings, messages, references, artifacts): the attachments' texts below their names, in order, codes and
    messages of what went wrong, references (JSON), and the files to write: of a name the last one.

    A note of a converter that succeeded is a warning of its own.
    """
    part = F.when(c("markdown").isNotNull(), F.concat(F.lit("### "), "name", F.lit("\n\n"), "markdown", F.lit("\n")))
    notes = F.transform("notes", lambda x: F.struct(F.lit(WARNED).alias("code"), F.concat(F.lit("Anhang '"), c("name"), F.lit("': "), x).alias("message")))
    warned = F.concat(F.when(c("code").isNotNull(), F.array(F.struct("code", "message"))).otherwise(F.array().cast("array<struct<code:string,message:string>>")), notes)
    g = extracted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p"), warned.alias("w"), "reference", "artifacts"))).alias("s"))
    each = lambda name: F.transform("s", lambda x: x[name])
    files = F.flatten(each("artifacts"))
    last = F.filter(files, lambda a, i: ~F.exists(F.slice(files, i + 2, F.size(files)), lambda b: b["name"] == a["name"]))
    flat = F.flatten(each("w"))
    return g.select(
        key, F.array_join(F.array_compact(each("p")), "\n").alias("sections"), F.transform(flat, lambda x: x["code"]).alias("warnings"), F.transform(flat, lambda x: x["message"]).alias("messages"),
        F.array_compact(each("reference")).alias("references"), last.alias("artifacts"),
    )


def attachment_stats(extracted: DataFrame, by: str = "suffix") -> DataFrame:
    """Attachments by suffix (or by warning code): how many, how many extracted, how many failed."""
    rows = extracted.where("code IS NOT NULL") if by == "code" else extracted
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(c("code").isNull()).alias("extracted"), F.count_if(c("code").isNotNull()).alias("failed"))


# ---------------------------------------------------------------- documents


def union_of_roots(spark: SparkSession, roots: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """The convertible files of several trees: path, rel_path, content, size, modified, origin; a tree that is missing is left out, and with ``only`` (paths) all other files."""
    out = None
    for origin, root in roots.items():
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            continue
        base = root.rstrip("/").removeprefix("file:")
        rows = contents(spark, root, CONVERTED, only).withColumns({"origin": F.lit(origin), "rel_path": F.regexp_replace("path", f"^(file:/*)?/*{base.lstrip('/')}/", "")})
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "path string, content binary, size long, modified timestamp, origin string, rel_path string")


def title_of(front_title: Column, other: Column, body: Column, name: Column) -> Column:
    """The front matter's title, else another source's, else the first heading of level 1, else the file's name."""
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    heading = some(F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1))
    stem = some(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[-_]", " "))
    return F.coalesce(some(front_title), some(other), heading, stem, collapse(name))
