"""Adapter views that turn the driver's tables into the engine's record shapes, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import chunking
from loomlake.operators.retrieval import Question

QUERIES = [(1, "that the"), (2, "the and"), (3, "handsh"), (4, "der und")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into windows, titled by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.simple_chunks(docs)


CHUNKS_SQL = r"""
body AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x0b\x1c-\x1f\x85\xa0]+|[\s\x0b\x1c-\x1f\x85\xa0]+$', '', 'g') AS t FROM documents
), starts AS (
  SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 1050)) AS st FROM body WHERE t <> ''
), chunks AS (
  SELECT doc_id, st // 1050 AS chunk_index, st AS chunk_start, st + length(substring(t, st + 1, 1200)) AS chunk_end,
         regexp_replace(substring(t, st + 1, 1200), '^[\s\x0b\x1c-\x1f\x85\xa0]+|[\s\x0b\x1c-\x1f\x85\xa0]+$', '', 'g') AS text,
         doc_id || '-chunk-' || lpad(CAST(st // 1050 AS VARCHAR), 4, '0') AS chunk_id
  FROM starts WHERE (st = 0 OR st - 1050 + 1200 < length(t))
)"""


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each, with title, section, tags and source type."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text", F.concat(F.lit("the "), F.coalesce("source", F.lit("")), F.lit(" "), F.coalesce("lang", F.lit(""))).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, "that section").otherwise("").alias("section_header"), F.array(F.lit("and"), F.coalesce("lang", F.lit(""))).alias("tags"),
        F.when(F.col("doc_id") % 4 == 0, "website").when(F.col("doc_id") % 4 == 1, "filesystem").otherwise("wiki").alias("source_type"),
    )


WHOLE_SQL = """
whole AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, text, 'the ' || coalesce(source, '') || ' ' || coalesce(lang, '') AS title,
         CASE WHEN doc_id % 3 = 0 THEN 'that section' ELSE '' END AS section_header, ['and', coalesce(lang, '')] AS tags,
         CASE WHEN doc_id % 4 = 0 THEN 'website' WHEN doc_id % 4 = 1 THEN 'filesystem' ELSE 'wiki' END AS source_type
  FROM documents
), q(query_id, query) AS (VALUES """ + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ")"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str, vectors_too: bool = False) -> list[Question]:
    """The fixed questions; with vectors, each asks with the embedding of vec_id 0 (one row)."""
    v: tuple[float, ...] = ()
    if vectors_too:
        row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
        v = tuple(float(x) for x in row[0]) if row else ()
    return [Question(i, t, v) for i, t in QUERIES]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events made from the event stream."""
    e = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("discover", "load", "transform", "filter", "chunk", "embed", "index")]), (k % 7 + 1).cast("int"))
    n = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        k.alias("id"), F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.when(F.col("user_id") % 2 == 0, "wiki").otherwise("filesystem").alias("source_type"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string"))).alias("source_instance"), F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("document_id"),
        F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("document_uri"), F.concat(F.lit("Title "), F.col("user_id").cast("string")).alias("document_title"), stage.alias("stage"),
        F.when(kind == "error", "error").when(kind == "signup", "warning").when(kind == "purchase", "skipped").otherwise("ok").alias("status"),
        F.when(kind == "error", "transform_exception").when(kind == "signup", "unsupported_macro").when((kind == "purchase") & (k % 2 == 0), "unchanged_incremental").when(kind == "purchase", "no_chunks_created").alias("reason_code"),
        F.concat(F.lit("m"), k.cast("string")).alias("message"), F.when(k % 5 == 0, n).alias("input_count"), n.alias("output_count"), n.alias("chunk_count"), F.col("ts").alias("created_at"), F.col("props").alias("extra_json"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id AS id, 'run-' || strftime(ts, '%Y%m%d') AS run_id, CASE WHEN user_id % 2 = 0 THEN 'wiki' ELSE 'filesystem' END AS source_type,
         CASE WHEN user_id % 3 > 0 THEN 'i' || (user_id % 3) END AS source_instance, 'doc-' || user_id AS document_id, 'u/' || user_id AS document_uri, 'Title ' || user_id AS document_title,
         ['discover', 'load', 'transform', 'filter', 'chunk', 'embed', 'index'][event_id % 7 + 1] AS stage,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'skipped' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' THEN 'transform_exception' WHEN event_type = 'signup' THEN 'unsupported_macro'
              WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'unchanged_incremental' WHEN event_type = 'purchase' THEN 'no_chunks_created' END AS reason_code,
         'm' || event_id AS message, CASE WHEN event_id % 5 = 0 THEN n END AS input_count, n AS output_count, n AS chunk_count, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events)
)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown bodies."""
    rows = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    g = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return g.select(F.col("conv_id").alias("doc_id"), F.concat_ws("\n\n", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string")), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n")).alias("body"))


MARKDOWN_SQL = """
md AS (
  SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || chr(10) ||
         string_agg('## ' || coalesce(role, '') || ' ' || turn || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id
)"""
