"""Transformed pages, issues and documents: front matter, file names, filters, replacement of earlier files, publishing.

Output files are rows (key, rel_path, content) of a table; a page's rows replace
all rows that the page had before, so renamed and vanished files go.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import frontmatter
from loomlake.functions.text import collapse, property_key, property_list, slug, strip
from loomlake.operators import markup, state
from loomlake.runtime import ensure_package

c = F.col
#: Titles that are no content, why a page is left out, bounds of pages, and the keys that a published file needs.
LOG_TITLE = r"(?iU)^log\s+\d{4}\b"
BY_RULE, SHORT = "filtered_by_rule", "too_small_for_chunking"
RAW_MINIMUM, FINAL_MINIMUM = 120, 200
OUTSOURCED = "Diese Tabelle wurde wegen komplexer Struktur aus der Hauptseite ausgelagert."
EXTRACTED, ANALYSED, LISTED, NO_NAME, NO_IMAGE = "## Anhang-Inhalte (extrahiert)", "## Abgeleitete Bildanalysen", "## Anhänge", "Anhang", "Bildanalyse"
ISSUE_LABELS = {"status": "Status", "issue_type": "Typ", "priority": "Priorität", "assignee": "Assignee", "reporter": "Reporter"}
DESCRIPTION, NO_DESCRIPTION = "## Beschreibung", "_Keine Beschreibung im Export gefunden._"
ABOUT_PROPERTIES = "seiteneigenschaft"
PUBLISH_KEYS = ["title", "source_type", "space_key", "page_id", "labels", "source_url"]

#: Properties that become front matter fields, by their labels; those in LISTS are lists.
PROMOTED = {
    "auftraggeber": ["auftraggeber"], "auftragnehmer": ["auftragnehmer"], "aufwand": ["aufwand"], "auslöser": ["auslöser", "ausloeser"], "betroffene einheiten": ["betroffene einheiten"], "jira": ["jira"],
    "komponente": ["komponente"], "komplexität": ["komplexität", "komplexitaet"], "modul/oft": ["modul/oft", "modul oft"], "priorität": ["priorität", "prioritaet", "prio"], "sponsoring": ["sponsoring"],
    "status": ["status"], "streamlead": ["streamlead"], "type": ["type"],
}
LISTS = ["betroffene einheiten"]


def promotion_rules(requested: list[str] | None = None) -> dict[str, set[str]]:
    """Normalised labels of each promoted property; only those of which some label is requested, all if none is."""
    every = {name: {markup.property_name(x) for x in (name, *aliases)} for name, aliases in PROMOTED.items()}
    asked = {markup.property_name(x) for x in requested or []}
    return {name: labels for name, labels in every.items() if labels & asked} or every


def promoted(properties: Column, rules: dict[str, set[str]]) -> Column:
    """A struct of the promoted properties of a map<string,string>: the first non-empty value of each, null without one."""
    entries = F.map_entries(properties)
    out = []
    for name, labels in rules.items():
        hits = F.filter(entries, lambda e: property_key(e["key"]).isin(*labels) & (collapse(F.coalesce(e["value"], F.lit(""))) != ""))  # noqa: B023
        value = F.try_element_at(F.transform(hits, lambda e: collapse(e["value"])), F.lit(1))
        out.append((property_list(value) if name in LISTS else value).alias(name))
    return F.struct(*out)


def verdict(title: Column, raw: Column, final: Column | None = None, complex_tables: Column | None = None, raw_minimum: int = RAW_MINIMUM, final_minimum: int = FINAL_MINIMUM) -> Column:
    """Why a page is left out, null for one that stays: a title that is no content, a raw or a final text that is too short.

    A page with a complex table stays however short its text is; a bound of 0 for final texts means the usual one.
    """
    out = F.when(title.rlike(LOG_TITLE), BY_RULE).when(F.length(F.coalesce(raw, F.lit(""))) < raw_minimum, SHORT)
    if final is not None:
        short = F.length(F.trim(F.coalesce(final, F.lit("")))) < (final_minimum or FINAL_MINIMUM)
        out = out.when(short & ~(F.lit(False) if complex_tables is None else complex_tables), SHORT)
    return out


def task_counts(text: Column, title: str) -> tuple[Column, Column]:
    """Number of tasks in a section of a rendered text, and the names mentioned there."""
    section = F.regexp_extract(F.concat(text, F.lit("\n## ")), rf"(?ms)^## {title}\n(.*?)^## ", 1)
    lines = F.regexp_extract_all(section, F.lit(r"(?m)^\s*Mentions:[^\S\n]*(.+?)\.[^\S\n]*$"), F.lit(1))
    names = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")
    return F.regexp_count(section, F.lit("(?m)^- ")), F.array_distinct(names)


def _json(**values: Column | str) -> Column:
    """A struct of front matter values as JSON, nulls left out."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]))


def task_fields(text: Column) -> Column:
    """A struct of the tasks of a rendered text: their number by status and who is mentioned there, null without any."""
    out = []
    for title, name in (("Open Tasks", "open"), ("Completed Tasks", "completed")):
        n, people = task_counts(text, title)
        out += [F.when(n > 0, n).alias(f"{name}_task_count"), F.when(n > 0, people).alias(f"{name}_task_mentions")]
    return F.struct(*out)


def titled(title: Column, text: Column) -> Column:
    """A page's text below its title."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), strip(text))


def issue_body(text: Column) -> Column:
    """An issue's text below its title and what is known of it: status, type, priority, people."""
    known = lambda name: F.when(c(name) != "", F.concat(F.lit("- "), F.lit(ISSUE_LABELS[name] + ": "), c(name)))
    facts = F.array_compact(F.array(*[known(name) for name in ISSUE_LABELS]))
    said = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(NO_DESCRIPTION)
    lead = F.when(F.size(facts) > 0, F.concat(F.array_join(facts, "\n"), F.lit(f"\n\n{DESCRIPTION}\n\n"))).otherwise("")
    return F.concat(F.lit("# "), "issue_key", F.lit(": "), "summary", F.lit("\n\n"), lead, said)


def with_attachments(markdown: Column, sections: Column, attachments: Column | None = None, references: Column | None = None, linked: bool = False, gap: str = "\n\n") -> Column:
    """A page's text, then what was extracted from its attachments, links to what was found in images, and the list of the attachments.

    ``references`` are JSON; ``linked`` says that attachments have a url; ``gap`` stands between extracted texts and links.
    """
    some = F.coalesce(sections, F.lit("")) != ""
    out = F.when(some, F.concat(markdown, F.lit(f"\n\n{EXTRACTED}\n\n"), strip(sections))).otherwise(markdown)
    if references is not None:
        at = lambda r, field: F.get_json_object(r, f"$.{field}")
        filed = F.filter(references, lambda r: F.coalesce(at(r, "derived_md_file"), F.lit("")) != "")
        links = F.transform(filed, lambda r: F.concat(F.lit("- ["), F.coalesce(at(r, "attachment_name"), F.lit(NO_IMAGE)), F.lit("]("), at(r, "derived_md_file"), F.lit(")")))
        out = F.when(F.size(filed) > 0, F.concat(out, F.when(some, gap).otherwise("\n\n"), F.lit(f"{ANALYSED}\n\n"), F.array_join(links, "\n"))).otherwise(out)
    if attachments is None:
        return out
    name = lambda a: F.coalesce(a["name"], F.lit(NO_NAME))
    line = lambda a: F.when(F.coalesce(a["url"], F.lit("")) != "", F.concat(F.lit("- ["), name(a), F.lit("]("), a["url"], F.lit(")"))).otherwise(F.concat(F.lit("- "), name(a))) if linked else F.concat(F.lit("- "), name(a))
    return F.when(F.size(attachments) > 0, F.concat(out, F.lit(f"\n{LISTED}\n\n"), F.array_join(F.transform(attachments, line), "\n"), F.lit("\n"))).otherwise(out)


def attachment_signature(attachments: Column) -> Column:
    """Names and places of attachments, in order: part of a content's hash."""
    return F.array_join(F.array_sort(F.transform(attachments, lambda a: F.concat(F.coalesce(a["name"], F.lit("")), F.lit("|"), F.coalesce(a["local_path"], F.lit(""))))), ",")


def attachment_names(attachments: Column) -> Column:
    return F.array_compact(F.transform(attachments, lambda a: a["name"]))


def _images(references: Column | None) -> dict[str, Column]:
    """What the front matter says of analysed images; ``render`` puts the references where they belong."""
    given = F.array().cast("array<string>") if references is None else F.coalesce(references, F.array().cast("array<string>"))
    return {"image_analysis_status": F.when(F.size(given) > 0, "complete").otherwise("not_applicable"), "image_attachment_count": F.size(given), "references": given}


def page_metadata(space_key: Column, references: Column | None = None, warnings: Column | None = None) -> Column:
    """Front matter of a page, as JSON, from the columns of a transformed page."""
    meta = F.struct(space_key.alias("space_key"), c("page_id"), (c("warnings") if warnings is None else warnings).alias("transform_warnings"))
    author = F.array_compact(F.array("author"))
    return _json(
        title=c("title"), source_type="confluence", source_system="confluence_export", source_key=F.lower(space_key), source_url=c("source_url"), original_id=c("page_id"), original_path=c("source_ref"), created_at=c("created_at"),
        updated_at=c("updated_at"), tags=c("labels"), authors=author, content_hash=c("content_hash"), attachments=attachment_names(c("attachments")), **_images(references), parent_title=c("parent_title"),
        ancestors=c("ancestors"), page_properties=c("page_properties"), unsupported_macros=c("unsupported"), doc_type="confluence_page", promoted=c("promoted"), source_meta=meta,
    )


def issue_metadata(references: Column | None = None, warnings: Column | None = None) -> Column:
    """Front matter of an issue, as JSON."""
    meta = F.struct(c("issue_key").alias("jira_key"), "issue_type", "status", "priority", "components", "fix_versions", (c("warnings") if warnings is None else warnings).alias("transform_warnings"))
    return _json(
        title=F.concat("issue_key", F.lit(": "), "summary"), source_type="jira", source_system="jira_export", source_key=F.lower("project_key"), source_url=c("source_url"), original_id=c("issue_id"), original_path=c("source_ref"),
        created_at=c("created_at"), updated_at=c("updated_at"), tags=c("labels"), authors=F.array_compact(F.array("reporter", "assignee")), content_hash=c("content_hash"), attachments=attachment_names(c("attachments")),
        **_images(references), source_meta=meta,
    )


def document_metadata() -> Column:
    """Front matter of a converted file, as JSON: tags are documents, its system and its domain."""
    meta = F.struct(c("origin").alias("source_origin"), c("rel_path").alias("logical_path"))
    return _json(
        title=c("title"), source_type="documents", source_system=c("origin"), source_key=c("document_id"), source_path=c("path"), original_path=c("rel_path"), domain=c("domain"), file_type=c("extension"), document_id=c("document_id"),
        source_modified_at=c("modified").cast("string"), source_size_bytes=c("size"), transformer=c("transformer"), tags=F.array(F.lit("documents"), "origin", "domain"), aliases=c("aliases"), source_meta=meta,
    )


def render(metadata: Column, body: Column) -> Column:
    """Front matter (JSON) and body as a Markdown file: unified fields in their order, empty ones left out, promoted ones among them."""

    def rendered(metas: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for meta, text in zip(metas, bodies):
            data = json.loads(meta)
            promoted = data.pop("promoted", None) or {}
            if found := [json.loads(r) for r in data.pop("references", None) or []]:
                data |= {"image_analysis": found, "source_meta": {**data.get("source_meta", {}), "image_analysis_refs": found}}
            out.append(frontmatter.render({**data, **promoted}, text or ""))
        return pd.Series(out)

    return F.pandas_udf(rendered, "string")(metadata, body)


def json_lines(metadata: Column, body: Column) -> Column:
    """A Markdown file with one ``key: json`` line for each entry of a map<string,string> of JSON values."""
    lines = F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), F.trim(body), F.lit("\n"))


def unsupported_macros(files: DataFrame, space: str | None = None) -> DataFrame:
    """Unsupported macros of page files (rel_path, content), by their front matter: (macro, n), most frequent first."""
    rows = files.where(F.lower(F.regexp_extract("rel_path", "([^/]*)/[^/]*$", 1)) == space.lower()) if space else files
    meta = rows.select(frontmatter.parse_column(c("content"))["meta"].alias("meta")).where(F.get_json_object("meta", "$.doc_type") == "confluence_page")
    macros = meta.select(F.explode(F.from_json(F.get_json_object("meta", "$.unsupported_macros"), "array<string>")).alias("macro"))
    return macros.groupBy("macro").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "macro")


def page_file(space: Column, key: Column, title: Column) -> Column:
    return F.concat(F.lower(space), F.lit("/"), key, F.lit("__"), slug(title, "untitled", 120), F.lit(".md"))


def document_file(rel_path: Column, document_id: Column, title: Column) -> Column:
    folder = F.regexp_extract(rel_path, "^(.*/)?[^/]*$", 1)
    return F.concat(folder, slug(title, "document"), F.lit("__"), F.substring(document_id, 1, 10), F.lit(".md"))


def page_files(rows: DataFrame) -> DataFrame:
    """(key, rel_path, content) of rendered pages with ``tables``: the page, a file for each complex table, and those that converters made (``artifacts``)."""
    ensure_package(rows.sparkSession)
    references, messages = (c(n) if n in rows.columns else None for n in ("references", "messages"))
    main = rows.select(c("page_id").alias("key"), page_file(c("space_key"), c("page_id"), c("title")).alias("rel_path"), render(page_metadata(c("space_key"), references, messages), c("markdown")).alias("content"))
    extra = rows.select(c("page_id").alias("key"), "space_key", "title", "parent_title", "source_url", "labels", "content_hash", F.posexplode("tables").alias("n", "table"))
    stem = F.regexp_replace(page_file(c("space_key"), c("key"), c("title")), r"\.md$", "")
    name = F.concat(stem, F.format_string("__table_%02d.md", c("n") + 1))
    said = lambda x: F.regexp_replace(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"^\[|\]$", "")
    head = F.create_map(
        F.lit("title"), said(F.format_string("Tabelle %02d aus %s", c("n") + 1, "title")), F.lit("source_type"), F.lit('"confluence"'), F.lit("space_key"), said(c("space_key")), F.lit("doc_type"), F.lit('"confluence_table"'),
        F.lit("page_id"), said(c("key")), F.lit("parent_title"), said(c("parent_title")), F.lit("table_index"), (c("n") + 1).cast("string"), F.lit("table_complexity"), F.lit("true"), F.lit("source_url"), said(c("source_url")),
        F.lit("labels"), F.to_json("labels"), F.lit("content_hash"), said(c("content_hash")), F.lit("transform_warnings"), F.lit('["complex_table"]'),
    )
    body = F.concat(F.lit("# Tabelle aus: "), "title", F.lit("\n\n"), F.lit(OUTSOURCED), F.lit("\nErkannte Struktur: "), "table.shape", F.lit(".\n\n## Inhalt (konservativ abgeflacht)\n\n"), "table.rows")
    out = main.unionByName(extra.select("key", name.alias("rel_path"), json_lines(head, body).alias("content")))
    return out.unionByName(artifact_files(rows, "page_id", c("space_key"))) if "artifacts" in rows.columns else out


def artifact_files(rows: DataFrame, key: str, space: Column) -> DataFrame:
    """(key, rel_path, content) of the files that converters made of a page's attachments, beside the page; other folders than its own are cut off their names."""
    each = rows.select(c(key).alias("key"), F.lower(space).alias("space"), F.explode("artifacts").alias("a"))
    return each.select("key", F.concat("space", F.lit("/"), F.regexp_extract("a.name", r"[^/\\]*$", 0)).alias("rel_path"), c("a.content").alias("content"))


def replace(existing: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Files after a run: all rows of the run's keys replace what those keys had; other keys keep theirs."""
    return state.upsert(existing, new, key)


def publish(staging: DataFrame, routes: DataFrame, input_root: str, output_root: str, fallback: str = "_unmapped/confluence", unmapped: bool = True) -> DataFrame:
    """What becomes of staging files (rel_path, metadata map<string,string> of JSON values, body, published_at).

    (rel_path, status, missing, target, content): error where a required key is missing, unmapped
    where the space has no route (routes: space, domain_path), else published.  Six keys are added.
    """
    keys = F.array(*[F.lit(k) for k in PUBLISH_KEYS])
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    missing = F.filter(keys, lambda k: ~F.map_contains_key(meta, k))
    text = lambda k: F.trim(F.regexp_replace(F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")), '^"|"$', ""))
    rows = staging.withColumns({"missing": missing, "space": text("space_key")}).join(routes.select(c("space"), c("domain_path").alias("route")), "space", "left")
    space = F.when(c("space") == "", "_missing_space").otherwise(c("space"))
    domain = F.coalesce("route", F.concat(F.lit(fallback.strip("/") + "/"), space))
    target = F.concat(F.lit(output_root.rstrip("/") + "/"), domain, F.lit("/"), F.regexp_extract("rel_path", "[^/]*$", 0))
    status = F.when(F.size("missing") > 0, "error").when(c("route").isNull(), "unmapped").otherwise("published")
    written = (status == "published") | ((status == "unmapped") & F.lit(unmapped))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    more = F.create_map(
        F.lit("published_from"), quoted(F.concat(F.lit(input_root.rstrip("/") + "/"), "rel_path")), F.lit("publish_source_root"), quoted(F.lit(input_root)), F.lit("publish_target_path"), quoted(target),
        F.lit("content_origin"), F.lit('"confluence"'), F.lit("domain_path"), quoted(domain), F.lit("published_at"), quoted(c("published_at").cast("string")),
    )
    own = F.map_filter(meta, lambda k, v: ~F.map_contains_key(more, k))
    return rows.select("rel_path", status.alias("status"), F.array_join("missing", ",").alias("missing"), F.when(written, target).alias("target"), F.when(written, json_lines(F.map_concat(own, more), c("body"))).alias("content"))
