"""Readers of Markdown trees and chunk files, and writers of what the engine keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions.text import has_meaningful_content

#: Files that are no content, and the extensions that have a converter.
SKIPPED = ["README.md", "readme.md", "_index.md"]
CONVERTED = ["pdf", "docx", "pptx", "xlsx", "xls", "csv", "json", "xml", "epub", "xsd", "html", "htm"]
c = F.col


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, rel_path, name, extension, size, modified) of a tree, without reading contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length")
    base = root.rstrip("/").removeprefix("file:")
    name = F.regexp_extract("path", "[^/]*$", 0)
    return rows.select("path", F.regexp_replace("path", f"^(file:/*)?/*{base.lstrip('/')}/", "").alias("rel_path"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), c("length").alias("size"), c("modificationTime").alias("modified"))


def markdown_documents(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """Markdown files with meaningful content: doc_id, path, rel_path, name, content, checksum. With ``only`` (paths) no other file is opened."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(c("value").alias("content"), c("_metadata.file_path").alias("path"), c("_metadata.file_name").alias("name"), c("_metadata.file_size").alias("size"))
    texts = texts if only is None else texts.where(c("path").isin(only))
    base = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace("path", f"^(file:/*)?/*{base.lstrip('/')}/", "")
    body = F.regexp_replace("content", r"(?s)^---\s*\n.*?\n---\s*(\n|$)", "")
    rows = texts.where(~c("name").isin(SKIPPED)).where(has_meaningful_content(body))
    return rows.select(F.sha2(F.lower(rel), 256).alias("doc_id"), "path", rel.alias("rel_path"), "name", "size", "content", F.sha2("content", 256).alias("checksum"))


def pick(json: Column, *paths: str) -> Column:
    """The first of several JSON paths that holds a value."""
    return F.coalesce(*[F.get_json_object(json, f"$.{p}") for p in paths])


def chunk_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Chunks from JSON lines; broken lines and chunks without ids or text are left out."""
    schema = "doc_id string, chunk_id string, title string, text string, metadata map<string,string>, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{root.rstrip('/')}/{pattern}")
    ok = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return rows.where(c("_bad").isNull() & ok(c("doc_id")) & ok(c("chunk_id")) & ok(c("text"))).select("doc_id", "chunk_id", F.coalesce("title", "doc_id").alias("title"), "text", "metadata")


def with_document_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Document metadata behind a chunk's own: the chunk wins where both have a key."""
    d = documents.select("doc_id", c("metadata").alias("_d"), c("source_ref"))
    rows = chunks.join(d, "doc_id", "left")
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce("metadata", empty)
    merged = F.map_concat(F.map_filter(F.coalesce("_d", empty), lambda k, v: ~F.map_contains_key(own, k)), own)
    return rows.withColumn("metadata", merged).drop("_d")


def inventory(rows: DataFrame) -> DataFrame:
    """Files, bytes and the first path by extension."""
    return rows.groupBy("extension").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("rel_path").alias("example"))


def samples(rows: DataFrame, k: int = 3) -> DataFrame:
    """The first k paths of each extension."""
    place = F.row_number().over(W.partitionBy("extension").orderBy("rel_path"))
    return rows.select("extension", "rel_path").withColumn("n", place).where(c("n") <= k).groupBy("extension").agg(F.array_sort(F.collect_list("rel_path")).alias("examples"))


def by_directory(rows: DataFrame) -> DataFrame:
    """Files by the first part of their path; files of the root itself count under a dot."""
    top = F.when(c("rel_path").contains("/"), F.regexp_extract("rel_path", "^([^/]*)/", 1)).otherwise(".")
    return rows.groupBy(top.alias("directory")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def coverage(exported: DataFrame, markdown: DataFrame) -> DataFrame:
    """One row: convertible files, Markdown files, and the latter's share of the former; null without any."""
    a = exported.where(c("extension").isin(CONVERTED)).agg(F.count("*").alias("supported"))
    b = markdown.where("extension = 'md'").agg(F.count("*").alias("markdown"))
    return a.crossJoin(b).withColumn("coverage", F.round(F.try_divide(c("markdown").cast("double"), c("supported")), 4))


def parse_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose embedding, a JSON text, is a list of numbers, with the list in its place."""
    v = F.from_json(c(column), "array<double>")
    return rows.withColumn(column, v).where(c(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull()))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet; with a partition column only the partitions of the given rows are replaced."""
    w = documents.write.mode("overwrite")
    (w.partitionBy(partition).option("partitionOverwriteMode", "dynamic") if partition else w).parquet(path)
