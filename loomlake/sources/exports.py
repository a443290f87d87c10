"""Readers of wiki and issue exports: one folder for each page or issue, JSON metadata beside a body, and attachments.

Only the files that a reader needs are read as texts; attachments are joined to a
listing of the tree, by folder and name, and never opened here.  Files whose JSON
is broken are left out, as are files outside the export's layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.readers import files, pick

c = F.col
#: What stands for a missing title, space or project.
NO_TITLE, UNKNOWN = "Ohne Titel", "unknown"
#: Fields of an attachment that name it, and those that give its place.
NAMES = ["name", "title", "filename", "fileName"]
PLACES = ["local_path", "localPath", "path", "file_path", "filePath", "filepath", "export_path", "absolute_path"]
ATTACHMENT = "array<struct<name:string,local_path:string,media_type:string,url:string>>"


def texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, value, path) of the files of one name (or glob) in a tree."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    path = c("_metadata.file_path")
    return rows.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), "value", path.alias("path"))


def present(x: Column) -> Column:
    """A text without white space at its ends; null if nothing is left."""
    return F.when(F.trim(x) != "", F.trim(x))


def strings(json: Column, *fields: str) -> Column:
    """A JSON list of texts, or of objects with one of some fields, as trimmed texts; a JSON text is split at commas."""
    items = F.from_json(json, "array<string>")
    own = lambda x: F.when(x.startswith("{"), pick(x, *fields) if fields else F.lit(None)).otherwise(x)
    listed = F.transform(items, lambda x: F.trim(own(x)))
    split = F.when(~F.coalesce(json, F.lit("")).rlike(r"^\s*[\[{]"), F.transform(F.split(json, ","), lambda x: F.trim(x)))
    return F.filter(F.coalesce(F.when(F.coalesce(json, F.lit("")).rlike(r"^\s*\["), listed), split, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def mapping(json: Column) -> Column:
    return F.coalesce(F.when(json.rlike(r"^\s*\{"), F.from_json(json, "map<string,string>")), F.create_map().cast("map<string,string>"))


def attachments(rows: DataFrame, listing: DataFrame, items: Column, folders: Column, check: bool) -> DataFrame:
    """Adds attachments and attachment_paths to rows (folder): for each item the first of its candidate places that exists.

    A place that an item gives itself comes first; with ``check`` it has to exist too.
    """
    name = F.coalesce(*[present(F.get_json_object("item", f"$.{x}")) for x in NAMES], F.when(~c("item").startswith("{"), present(c("item"))))
    given = F.array_compact(F.array(*[present(F.get_json_object("item", f"$.{x}")) for x in (PLACES if check else PLACES[:1])]))
    each = rows.select("folder", folders.alias("folders"), F.posexplode(items).alias("pos", "item"))
    each = each.select("folder", "folders", "pos", name.alias("name"), given.alias("given"), pick(c("item"), "media_type", "mediaType", "metadata.mediaType").alias("media_type"), present(pick(c("item"), "url", "downloadUrl")).alias("url"))
    base = F.regexp_extract("name", "[^/]*$", 0)
    absolute = F.transform("given", lambda p: F.when(p.startswith("/") | p.contains(":/"), p).otherwise(F.concat("folder", F.lit("/"), p)))
    places = F.concat(absolute, F.when(base != "", F.transform("folders", lambda f: F.concat(f, F.lit("/"), base))).otherwise(F.array().cast("array<string>")))
    plain = lambda p: F.regexp_replace(p, "^file:/*", "/")
    tries = each.select("folder", "pos", "name", "media_type", "url", F.try_element_at("given", F.lit(1)).alias("own") if not check else F.lit(None).cast("string").alias("own"), F.posexplode_outer(places).alias("order", "place"))
    there = listing.select(plain(c("path")).alias("place"), F.lit(True).alias("there")).distinct()
    found = tries.withColumn("place", plain(c("place"))).join(there, "place", "left")
    best = found.groupBy("folder", "pos").agg(F.first("name").alias("name"), F.first("media_type").alias("media_type"), F.first("url").alias("url"), F.first("own").alias("own"), F.min_by("place", F.when(c("there"), c("order"))).alias("place"))
    best = best.select("folder", "pos", F.struct("name", F.coalesce("own", "place").alias("local_path"), "media_type", "url").alias("a"))
    lists = best.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("s"))
    lists = lists.select("folder", F.transform("s", lambda x: x["a"]).cast(ATTACHMENT).alias("attachments"))
    empty = F.array().cast(ATTACHMENT)
    out = rows.join(lists, "folder", "left").withColumn("attachments", F.coalesce("attachments", empty))
    return out.withColumn("attachment_paths", F.array_distinct(F.array_compact(F.transform("attachments", lambda a: a["local_path"]))))


def wiki_pages(spark: SparkSession, root: str, spaces: list[str] | None = None) -> DataFrame:
    """Pages: metadata.json in ``by-id/<id>`` or ``by-id/<shard>/<id>``, with content.storage.xml beside it as body."""
    folder = c("folder")
    meta = texts(spark, root, "metadata.json").where(folder.rlike("/by-id(/[^/]+){1,2}$") & ~folder.rlike("/by-id/by-id$") & F.try_parse_json("value").isNotNull())
    body = texts(spark, root, "content.storage.xml").select("folder", c("value").alias("stored"))
    j = c("value")
    rows = meta.join(body, "folder", "left")
    ancestors = F.filter(F.transform(F.from_json(pick(j, "ancestors"), "array<string>"), lambda x: F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.title")).otherwise(x))), lambda x: x.isNotNull() & (x != ""))
    ancestors = F.coalesce(ancestors, F.array().cast("array<string>"))
    space = F.coalesce(present(pick(j, "space_key")), present(pick(j, "space.key")), F.when(~pick(j, "space").startswith("{"), present(pick(j, "space"))), present(pick(j, "spaceKey")), F.lit(UNKNOWN))
    direct = pick(j, "body_storage", "body", "content", "body.value")
    rows = rows.select(
        "folder", F.coalesce(present(pick(j, "page_id", "id", "content_id")), F.regexp_extract("folder", "[^/]*$", 0)).alias("page_id"), space.alias("space_key"),
        F.coalesce(present(pick(j, "title", "page_title", "name")), F.lit(NO_TITLE)).alias("title"),
        F.coalesce("stored", F.when(~direct.rlike(r"^\s*\{"), present(direct)), pick(j, "body.storage.value"), F.lit("")).alias("body"), c("path").alias("source_ref"),
        present(pick(j, "source_url", "url", "_links.webui")).alias("source_url"), present(pick(j, "created_at", "created", "history.createdDate")).alias("created_at"),
        present(pick(j, "updated_at", "updated", "version.when")).alias("updated_at"), present(pick(j, "author", "created_by", "history.createdBy.displayName")).alias("author"),
        strings(pick(j, "labels", "metadata.labels"), "name", "label").alias("labels"), F.coalesce(present(pick(j, "parent_title", "parent.title")), F.try_element_at(ancestors, F.lit(-1))).alias("parent_title"),
        ancestors.alias("ancestors"), mapping(pick(j, "page_properties", "properties")).alias("page_properties"), F.from_json(pick(j, "attachments"), "array<string>").alias("items"), j.alias("meta"),
    )
    rows = rows.where(F.lower("space_key").isin([s.lower() for s in spaces])) if spaces else rows
    listing = files(spark, root).where(c("path").rlike("/attachments/[^/]+$"))
    return attachments(rows, listing, c("items"), F.array(F.concat("folder", F.lit("/attachments"))), check=False).drop("items", "folder")


def issues(spark: SparkSession, root: str, projects: list[str] | None = None) -> DataFrame:
    """Issues: content.storage.json, else metadata.json, in a folder below issues, by-key or by-id; a description file comes before the JSON's text."""
    layout = c("folder").rlike(r"(?i)/(issues|by-key|by-id)/[^/.][^/]*$")
    sources = texts(spark, root, "content.storage.json").withColumn("o", F.lit(0)).unionByName(texts(spark, root, "metadata.json").withColumn("o", F.lit(1)))
    own = sources.where(layout & F.try_parse_json("value").isNotNull()).groupBy("folder").agg(F.min_by(F.struct("value", "path"), F.struct("o", "path")).alias("s"))
    rank = F.when(c("path").endswith(".md"), 0).when(c("path").endswith(".txt"), 1).otherwise(2)
    described = texts(spark, root, "description.{md,txt,html}").where(layout).groupBy("folder").agg(F.min_by("value", rank).alias("described"))
    j, folder = c("s.value"), c("folder")
    last = F.regexp_extract(folder, "[^/]*$", 0)
    inside = lambda kind: folder.rlike(f"(?i)/{kind}/[^/]+$")
    number = F.coalesce(present(pick(j, "id", "issue_id", "issue.id", "issueId")), F.when(inside("by-id"), last))
    key = F.coalesce(present(pick(j, "key", "issue_key", "issue.key", "issueKey")), F.when(inside("by-key"), last), number)
    by_path = F.regexp_extract(folder, r"(?i)/projects/([^/]+)(?=/)", 1)
    by_path = F.when(~F.lower(by_path).isin("", "issues", "by-id", "by-key", "attachments"), by_path)
    by_key = F.when(key.contains("-"), F.regexp_extract(key, "^([^-]+)-", 1))
    project = F.coalesce(present(pick(j, "project_key", "project.key", "fields.project.key")), by_path, present(by_key), F.lit(UNKNOWN))
    said = pick(j, "description", "fields.description", "renderedFields.description", "content", "storage", "body.storage.value", "issue.content", "issue.description")
    named = lambda *paths: strings(pick(j, *paths), "name")
    rows = own.join(described, "folder", "left").select(
        "folder", F.coalesce(number, key).alias("issue_id"), key.alias("issue_key"), project.alias("project_key"), F.coalesce(present(pick(j, "summary", "title", "fields.summary", "issue.summary")), F.lit(NO_TITLE)).alias("summary"),
        F.coalesce("described", said, F.lit("")).alias("description"), c("s.path").alias("source_ref"), present(pick(j, "source_url", "url", "self", "browse_url")).alias("source_url"),
        present(pick(j, "created_at", "created", "fields.created")).alias("created_at"), present(pick(j, "updated_at", "updated", "fields.updated")).alias("updated_at"),
        present(pick(j, "issue_type", "fields.issuetype.name")).alias("issue_type"), present(pick(j, "status", "fields.status.name")).alias("status"), present(pick(j, "priority", "fields.priority.name")).alias("priority"),
        present(pick(j, "assignee", "fields.assignee.displayName", "fields.assignee.name")).alias("assignee"), present(pick(j, "reporter", "fields.reporter.displayName", "fields.reporter.name")).alias("reporter"),
        strings(pick(j, "labels", "fields.labels")).alias("labels"), named("components", "fields.components").alias("components"), named("fix_versions", "fields.fixVersions").alias("fix_versions"),
        F.coalesce(F.from_json(pick(j, "attachments", "fields.attachment"), "array<string>"), F.array().cast("array<string>")).alias("items"), j.alias("meta"),
    )
    rows = rows.where(F.lower("project_key").isin([p.lower() for p in projects])) if projects else rows
    listing = files(spark, root)
    home = F.regexp_extract("folder", r"(?i)^(.*/projects)(/|$)", 1)
    stored = F.when(home != "", F.concat(home, F.lit("/attachments/"), "issue_key"))
    # files kept for the issue that its JSON does not name are attachments too
    kept = listing.where(c("path").rlike(r"(?i)/projects/attachments/[^/]+/[^/.][^/]*$")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("store"), "name")
    kept = kept.groupBy("store").agg(F.array_sort(F.collect_set("name")).alias("kept"))
    rows = rows.withColumn("store", stored).join(kept, "store", "left")
    names = F.transform("items", lambda x: F.coalesce(*[present(F.get_json_object(x, f"$.{n}")) for n in ("name", "filename", "title")], x))
    rows = rows.withColumn("items", F.concat("items", F.array_except(F.coalesce("kept", F.array().cast("array<string>")), names)))
    parent = F.regexp_extract("folder", "^(.*)/[^/]*$", 1)
    folders = F.array_compact(F.array("folder", *[F.concat("folder", F.lit(f"/{x}")) for x in ("attachments", "attachment", "files")], F.concat(parent, F.lit("/attachments")), "store"))
    return attachments(rows, listing, c("items"), folders, check=True).drop("items", "folder", "store", "kept")
