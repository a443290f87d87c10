"""The training-data pipeline: quality rules, near copies, decontamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept and returns a frame whose decisions take effect; all but the last return
the columns of ``documents``.  ``run`` applies them in order and stores each
stage's result as Parquet in the shared folder, as a runner of ``STAGES`` does.

Cases: a null or empty text fails the quality rules and goes.  Rows with a null
id are documents of their own for near copies, and of rows with the same id and text
one stays; of a class the smallest id stays (a null id comes last).  Rows of one id
with different texts count as one document and stay or go together.
Ids whose labels contradict each other are not learned from.  Texts of any length
are handled whole, empty tables give empty tables, and columns of ``documents``
beyond COLUMNS are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import bpe, decontaminate, jaccard, pii, quality
from loomlake.llm.common import stored, table
from loomlake.llm.queries import vocabulary
from loomlake.runtime import ensure_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ensure_package(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.apply(docs.select(COLUMNS), model).where("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles, Jaccard 0.8 or more)."""
    number = F.monotonically_increasing_id()
    key = F.coalesce("doc_id", F.lit(1 << 62) + F.col("__row"))
    rows = docs.select(COLUMNS).withColumn("__row", number).withColumns({"__key": key, "__text": F.md5(F.coalesce("text", F.lit("")).cast("binary"))})
    rows = stored(rows, "near-copies-rows")
    found = jaccard.classes(rows.select("__key", "text"), key="__key", size=5, percent=80)
    copies = found.where("component_id <> __key").select("__key").distinct()
    narrow = rows.select("__row", "__key", "__text")
    repeats = narrow.groupBy("__key", "__text").agg(F.min("__row").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = narrow.join(repeats, ["__key", "__text"]).where("__row <> first").select("__row")
    gone = narrow.join(copies, "__key", "left_semi").select("__row").unionByName(repeats)
    return rows.join(gone, "__row", "left_anti").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    ensure_package(spark)
    return decontaminate.scan(docs.select(COLUMNS), table(spark, sf_dir, "benchmark", "item_id", "text")).where(F.size("leaks") == 0).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind in brackets."""
    ensure_package(spark)
    found = pii.detect(docs.select(COLUMNS), redacted="__clean")
    return found.withColumn("text", F.col("__clean")).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether these decode to the text again."""
    ensure_package(spark)
    return bpe.encode(docs.select(COLUMNS), vocabulary(), keep=["doc_id", "lang", "source"], decoded=False, exact=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Fitted models and token ids cannot be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
