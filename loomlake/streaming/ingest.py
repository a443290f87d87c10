"""Incremental ingestion: the batch operators run on each micro-batch, with state kept as versions.

    <root>/chunks/batch=<n>   the chunks of the batch's new and changed documents
    <root>/state/batch=<n>    their checksums
    <root>/commits/<n>        written last: the batch counts from then on

A batch reads only the state of committed batches with smaller numbers, never its
own output, so a retry after a failure at any step (or after the commit) finds the
same new and changed documents and writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlake.functions.text import strip
from loomlake.operators import chunking, state

STATE = "key string, checksum string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed batches, in order."""
    fs, folder = _folder(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def _read(spark: SparkSession, root: str, kind: str, schema, before: int | None) -> DataFrame:
    paths = [f"{root}/{kind}/batch={n}" for n in committed(spark, root) if before is None or n < before]
    rows = spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows if paths else rows.withColumn("batch", F.lit(0))


def current_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The checksum of each document as the last committed batch (smaller than ``before``) left it."""
    return _read(spark, root, "state", STATE, before).groupBy("key").agg(F.max_by("checksum", "batch").alias("checksum"))


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of each document's last committed version."""
    kinds = chunking.simple_chunks(spark.createDataFrame([], "key string, text string"), key="key").schema
    chunks = _read(spark, root, "chunks", kinds, None)
    last = _read(spark, root, "state", STATE, None).groupBy("key").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["key", "batch"], "left_semi").drop("batch")


def last_version(docs: DataFrame, order: str | None = None) -> DataFrame:
    """Of each key the last text by the order column, then by the text itself."""
    rank = F.struct(*([order] if order else []), F.coalesce("text", F.lit("")))
    return docs.where("key IS NOT NULL").groupBy("key").agg(F.max_by("text", rank).alias("text"))


def ingest_batch(docs: DataFrame, batch: int, root: str, order: str | None = None, full: bool = False) -> None:
    """Chunks the new and changed documents (key, text) of a batch and records their checksums; ``full`` takes all as changed.

    Rows without key are left out.  A document without text has no chunks and its checksum all the same.
    """
    spark = docs.sparkSession
    last = last_version(docs, order).withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    before = current_state(spark, root, batch)
    todo = last.join(state.change_status(last, before).where(F.lit(full) | (F.col("status") != "unchanged")).select("key"), "key", "left_semi")
    chunking.simple_chunks(todo.where(strip(F.coalesce("text", F.lit(""))) != ""), key="key").write.mode("overwrite").parquet(f"{root}/chunks/batch={batch}")
    todo.select("key", "checksum").write.mode("overwrite").parquet(f"{root}/state/batch={batch}")
    fs, mark = _folder(spark, f"{root}/commits/{batch}")
    fs.create(mark, True).close()


def ingest_stream(docs: DataFrame, root: str, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Runs ``ingest_batch`` on a stream of (key, text) until everything available is taken in."""
    return docs.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, root, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and stage on a stream or a table (an extension: event time with a watermark)."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "stage", "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "stage", "status", "n")
