"""Scraped sites: import of a crawl by its manifest, conversion of scraped files, mapping into a domain tree."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions import frontmatter
from loomlake.functions.text import title_from_name
from loomlake.operators import convert
from loomlake.runtime import ensure_package
from loomlake.sources.readers import pick

c = F.col
#: Keys of a manifest that list pages, and the fields of a page that may hold its path.
LISTS = ["pages", "documents", "items"]
PATHS = ["markdown_rel_path", "relative_markdown_path", "markdown_path", "relative_path", "path", "file", "output_path"]
UP_TO_DATE = "changed-only: existing artifacts are newer than source"
#: Mapping rules that a plan takes at most.
MOST_RULES = 50_000


def page_path(item: Column) -> Column:
    """A page's Markdown path below pages/, by the first field that holds one."""
    out = []
    for name in PATHS:
        p = F.replace(F.get_json_object(item, f"$.{name}"), F.lit("\\"), F.lit("/"))
        p = F.when(p.contains("/pages/"), F.regexp_extract(p, r"(?s)^.*?/pages/(.*)$", 1)).otherwise(F.regexp_replace(p, "^pages/", ""))
        out.append(F.when(p.endswith(".md"), p))
    return F.coalesce(*out)


def manifest_pages(manifest: DataFrame) -> DataFrame:
    """(rel_path, item) of a manifest (value: JSON text); of several items of a path the last counts."""
    lists = F.coalesce(*[F.when(F.size(x) > 0, x) for x in (F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in LISTS)])
    rows = manifest.select(F.posexplode(lists).alias("pos", "item")).where(c("item").startswith("{")).withColumn("rel_path", page_path(c("item")))
    return rows.where("rel_path IS NOT NULL").groupBy("rel_path").agg(F.max_by("item", "pos").alias("item"))


def import_pages(pages: DataFrame, manifest: DataFrame, source_key: str, domain: str, imported_at: str, headings: bool = True) -> DataFrame:
    """(rel_path, content): pages (rel_path, name, content) with unified front matter from their own, the manifest and the import.

    A page that the manifest does not list is imported all the same.
    """
    rows = pages.join(manifest_pages(manifest), "rel_path", "left")
    first = manifest.agg(F.first("value").alias("m"))  # one file
    rows = rows.crossJoin(F.broadcast(first)).withColumn("parsed", frontmatter.parse_column(c("content")))
    item, own = c("item"), c("parsed.meta")
    some = lambda json, *paths: F.coalesce(*[F.when(F.trim(pick(json, p)) != "", F.trim(pick(json, p))) for p in paths])
    head = F.when(F.lit(headings), c("parsed.body")).otherwise(F.lit(""))
    updates = F.to_json(F.struct(
        convert.title_of(F.get_json_object(own, "$.title"), some(item, "title", "page_title"), head, c("name")).alias("title"), F.lit("external_website").alias("source_type"), F.lit("website").alias("source_system"),
        F.lit(source_key).alias("source_key"), some(item, "source_url", "url", "canonical_url").alias("source_url"), some(item, "id", "page_id", "doc_id", "url").alias("original_id"), c("rel_path").alias("original_path"),
        F.lit(imported_at).alias("imported_at"), F.coalesce(some(own, "status"), F.lit("raw")).alias("status"),
        F.struct(
            F.coalesce(some(c("m"), "domain", "source_domain"), F.lit(domain)).alias("source_domain"), F.coalesce(some(c("m"), "crawl_timestamp", "exported_at", "created_at"), F.lit("")).alias("crawl_timestamp"),
            F.coalesce(some(item, "content_type", "type"), F.lit("markdown")).alias("content_type"),
        ).alias("source_meta"),
    ))

    def merged(metas: pd.Series, more: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([frontmatter.render(frontmatter.merge(json.loads(a), json.loads(b)), t or "") for a, b, t in zip(metas, more, bodies)])

    return rows.select("rel_path", F.pandas_udf(merged, "string")(own, updates, c("parsed.body")).alias("content"))


def targets(rel_path: Column) -> tuple[Column, Column]:
    """Where a file's Markdown and metadata go."""
    stem = F.regexp_replace(rel_path, r"\.[^./]*$", "")
    return F.concat(F.lit("scraping/"), stem, F.lit(".md")), F.concat(F.lit("scraping/"), stem, F.lit(".meta.json"))


def plan(files: DataFrame, existing: DataFrame | None = None, limit: int | None = None, converters: tuple = convert.CONVERTERS) -> DataFrame:
    """What becomes of each file (rel_path, modified): convert, or skipped with a warning.

    ``existing`` (rel_path, modified) holds the files already written; one whose Markdown and metadata
    are both newer is skipped.  ``limit`` takes the first supported files by path.
    """
    ext = convert.extension(c("rel_path"))
    by = convert.route(ext, converters)
    md, meta = targets(c("rel_path"))
    rows = files.withColumns({"extension": ext, "transformer": by, "markdown_path": md, "metadata_path": meta, "fresh": F.lit(False)})
    if existing is not None:
        at = lambda path, name: existing.select(c("rel_path").alias(path), c("modified").alias(name))
        rows = rows.join(at("markdown_path", "_md"), "markdown_path", "left").join(at("metadata_path", "_meta"), "metadata_path", "left")
        rows = rows.withColumn("fresh", F.coalesce((c("_md") >= c("modified")) & (c("_meta") >= c("modified")), F.lit(False))).drop("_md", "_meta")
    if limit is not None:
        first = rows.where("transformer IS NOT NULL").select("rel_path").orderBy("rel_path").limit(limit)
        last = first.agg(F.max("rel_path").alias("last"))
        rows = rows.crossJoin(F.broadcast(last)).where(c("rel_path") <= c("last")).drop("last")
    shown = F.when(ext == "", "<none>").otherwise(F.concat(F.lit("."), ext))
    warning = F.when(by.isNull(), F.concat(F.lit("unsupported extension: "), shown)).when(c("fresh"), UP_TO_DATE)
    return rows.withColumns({"status": F.when(warning.isNull(), "convert").otherwise("skipped"), "warning": warning}).drop("fresh")


def unsupported(plan_: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent extensions without a converter."""
    own = plan_.where("transformer IS NULL").groupBy(F.when(c("extension") == "", "<none>").otherwise(F.concat(F.lit("."), "extension")).alias("extension"))
    return own.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(k)


def transform(planned: DataFrame, contents: DataFrame, run_id: str, at: str, converters: tuple = convert.CONVERTERS) -> DataFrame:
    """The planned files converted: rel_path, markdown_path, metadata_path, markdown, status and the metadata record."""
    todo = contents.join(planned.where("status = 'convert'").select("path", "rel_path", "markdown_path", "metadata_path", "extension"), "path")
    done = convert.convert(todo, converters)
    lines = F.when(c("markdown") == "", 0).otherwise(F.regexp_count(F.regexp_replace("markdown", r"\r?\n$", ""), F.lit(r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85]")) + 1)
    return done.select(
        "path", "rel_path", "markdown_path", "metadata_path", F.when(c("success"), c("markdown")).otherwise("").alias("markdown"), F.when(c("success"), "transformed").otherwise("failed").alias("status"),
        F.struct(
            F.lit("scraping").alias("source_system"), c("path").alias("source_path"), c("rel_path").alias("relative_source_path"), F.regexp_extract("rel_path", "[^/]*$", 0).alias("file_name"), F.concat(F.lit("."), "extension").alias("extension"),
            "transformer", F.lit(at).alias("transformed_at"), "warnings", F.length("markdown").alias("markdown_char_count"), lines.alias("markdown_line_count"), "success", F.lit(run_id).alias("run_id"), "sha256", "error",
        ).alias("record"),
    )


class Rules:
    """Mapping rules for one pass over a path: the first rule all of whose set parts hold.

    All parts that stand in a path are found at once by two automata, one over the path (prefixes and substrings)
    and one over the lower-cased file name.  A rule waits under the part that the fewest other rules wait under, so only
    rules with a part that holds are looked at, in their order.
    """

    def __init__(self, rules: Iterable[tuple]):
        """rules: (ord, id, target_subpath, path_prefix, path_contains, file_name_contains)."""
        self.rules = [tuple(r) for r in rules]
        self.names: dict[tuple[str, str], int] = {}
        self.targets: list[tuple[int, str, str, frozenset[int]]] = []
        for ord_, id_, target, *own in sorted(self.rules, key=lambda r: r[0]):
            kinds = zip(("prefix", "part", "name"), (own[0] or "", own[1] or "", (own[2] or "").lower()))
            parts = frozenset(self.names.setdefault(x, len(self.names)) for x in kinds if x[1])
            self.targets.append((len(self.targets), id_, target, parts))
        load = Counter(p for *_, parts in self.targets for p in parts)
        self.always = [t for t in self.targets if not t[3]]
        self.waiting: dict[int, list] = {}
        for t in self.targets:
            if t[3]:
                self.waiting.setdefault(min(t[3], key=lambda p: (load[p], p)), []).append(t)
        self.path, self.name = ahocorasick.Automaton(), ahocorasick.Automaton()
        held: dict[tuple[bool, str], list[tuple[str, int]]] = {}
        for (kind, pattern), at in self.names.items():
            held.setdefault((kind == "name", pattern), []).append((kind, at))
        for (by_name, pattern), own in held.items():
            (self.name if by_name else self.path).add_word(pattern, (len(pattern), own))
        for a in (self.path, self.name):
            if len(a):
                a.make_automaton()

    def __reduce__(self):
        return Rules, (self.rules,)

    def first(self, path: str | None) -> tuple[str, str] | None:
        """(id, target_subpath) of the first rule that holds."""
        if path is None:
            return None
        best = self.always[0] if self.always else None
        path = path.replace("\\", "/")
        holds: set[int] = set()
        if len(self.path):
            for last, (size, own) in self.path.iter(path):
                holds.update(at for kind, at in own if kind == "part" or last + 1 == size)
        if len(self.name):
            for _, (_, own) in self.name.iter(path.rpartition("/")[2].lower()):
                holds.update(at for _, at in own)
        for part in holds:
            for t in self.waiting.get(part, ()):
                if best is not None and t[0] >= best[0]:
                    break
                if t[3] <= holds:
                    best = t
                    break
        return None if best is None else best[1:3]


def choose_rule(rows: DataFrame, rules: DataFrame, path: str = "rel_path", default: str = "external/unassigned") -> DataFrame:
    """Adds rule_id and target_subpath: the first rule (ord, id, target_subpath, path_prefix, path_contains, file_name_contains) all of whose set parts hold.

    One projection, without a join: rules are part of the plan, MOST_RULES at most.
    """
    ensure_package(rows.sparkSession)
    known = rules.select("ord", "id", "target_subpath", "path_prefix", "path_contains", "file_name_contains").limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"there are more than {MOST_RULES} rules")
    shared = rows.sparkSession.sparkContext.broadcast(Rules(map(tuple, known)))

    def chosen(paths: pd.Series) -> pd.DataFrame:
        found = [shared.value.first(p) or ("default", default) for p in paths]
        return pd.DataFrame([(i or "default", t or default) for i, t in found], columns=["rule_id", "target_subpath"])

    done = F.pandas_udf(chosen, "rule_id string, target_subpath string")(c(path))
    return rows.withColumn("_rule", done).select("*", "_rule.rule_id", "_rule.target_subpath").drop("_rule")


def map_to_domains(records: DataFrame, markdown: DataFrame, rules: DataFrame, at: str, existing: DataFrame | None = None, default: str = "external/unassigned") -> DataFrame:
    """Where converted files go in the domain tree, with their enriched metadata.

    records: markdown_path, record (see ``transform``), title and tags if any; markdown: (markdown_path) of the texts there are;
    existing: (target) of files already mapped.  Status: failed without a text, skipped where the target exists, else mapped.
    """
    rows = records.select("markdown_path", c("record.relative_source_path").alias("rel_path"), c("record.file_name").alias("file_name"))
    rows = choose_rule(rows, rules, default=default).join(markdown.select("markdown_path", F.lit(True).alias("there")), "markdown_path", "left")
    rows = rows.withColumn("target", F.concat("target_subpath", F.lit("/"), F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.lit(".md")))
    if existing is not None:
        rows = rows.join(existing.select("target", F.lit(True).alias("done")), "target", "left")
    else:
        rows = rows.withColumn("done", F.lit(None).cast("boolean"))
    status = F.when(c("there").isNull(), "failed").when(c("done"), "skipped").otherwise("mapped")
    return rows.select(
        "rel_path", status.alias("status"), c("rule_id").alias("mapping_rule_id"), "target", c("target_subpath").alias("domain"), F.lit("scraped_asset").alias("source_kind"), F.lit("scraping").alias("source_system"),
        c("rel_path").alias("original_relative_path"), c("markdown_path").alias("transformed_relative_path"), title_from_name(c("file_name")).alias("title"), F.lit(at).alias("mapped_at"),
    )


def latest(records: DataFrame) -> DataFrame:
    """Of each pipeline's run records the one that started last."""
    return records.withColumn("_rn", F.row_number().over(W.partitionBy("pipeline").orderBy(F.desc("started_at"), F.desc("run_id")))).where("_rn = 1").drop("_rn")
