"""Token counts kept as delta-maintained rollups.

A change is an insert, a revision or a delete of one document's count under one
tokenizer version.  A batch of changes is turned into signed rows against the
ledger of the counts in force: a revision takes the old count out and puts the
new one in, possibly under another source or language; a delete only takes out.
Signed rows are summed by source, language and tokenizer version; the totals are
the sum of all committed batches' sums, so a batch never reads the documents of
earlier ones again.

Storage is a folder of committed batches in the shared folder of the session:

    <root>/batch=<id>/ledger   the ledger rows that the batch sets (count null: deleted)
    <root>/batch=<id>/totals   the batch's signed sums
    <root>/commits/<id>        written last: the batch counts from then on
    <root>/base=<id>/ledger    the counts in force after a batch, and
    <root>/bases/<id>          its mark, written by ``compact``

A batch without its commit mark is ignored and written anew; committing a batch
id again changes nothing, so a driver may retry after any failure.  Batches are
applied in the order of their ids; ids must grow.  An empty batch is committed like
any other.  One writer at a time: of two that commit one id at once, the files of
the one that writes last count.

Within a batch the last change (by ``seq``, then by the larger count, ties by
source and language) of a document and version counts.  Null document ids or
versions are ignored; null source and language are totals of their own; a null
count is a delete.
Deletes of unknown documents change nothing; inserts of known ones are revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["source", "lang", "tokenizer"]
CHANGES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType()),
])
LEDGER = T.StructType([*CHANGES.fields[2:], T.StructField("batch", T.LongType())])
TOTALS = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


class TokenCounts:
    """Rollups under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Ids of the committed batches, in order."""
        return self._marks("commits")

    def _marks(self, kind: str) -> list[int]:
        folder = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _mark(self, kind: str, batch: int) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/{kind}"))
        self._fs.create(self._path(f"{self.root}/{kind}/{batch}"), True).close()

    def compact(self) -> None:
        """Writes the counts in force as one table, which later commits read instead of all batches before; a failure leaves the ledger as it was."""
        done = self.committed()
        if not done or done[-1] in self.bases():
            return
        rows = self.ledger(done).select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.lit(done[-1]).cast("long").alias("batch"))
        rows.repartitionByRange("doc_id", "tokenizer").write.mode("overwrite").parquet(f"{self.root}/base={done[-1]}/ledger")
        self._mark("bases", done[-1])

    def _read(self, kind: str, schema: T.StructType, batches: list[int]) -> DataFrame:
        paths = [f"{self.root}/batch={b}/{kind}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bases(self) -> list[int]:
        """Batches up to which the ledger has been compacted."""
        return self._marks("bases")

    def ledger(self, batches: list[int] | None = None, of: DataFrame | None = None) -> DataFrame:
        """The counts in force, of all documents or those ``of`` a frame of ids and versions: what the last committed batch set."""
        batches = self.committed() if batches is None else batches
        base = [b for b in self.bases() if b in batches][-1:]
        paths = [f"{self.root}/base={b}/ledger" for b in base] + [f"{self.root}/batch={b}/ledger" for b in batches if not base or b > base[0]]
        rows = self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)
        if of is not None:
            rows = rows.join(of, ["doc_id", "tokenizer"], "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("v")
        return rows.groupBy("doc_id", "tokenizer").agg(last).where("v.n_tokens IS NOT NULL").select("doc_id", "tokenizer", "v.source", "v.lang", "v.n_tokens")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch of changes; False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        given = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGES.fields]).where("doc_id IS NOT NULL AND tokenizer IS NOT NULL")
        deleted = (F.col("op") == "delete") | F.col("n_tokens").isNull()
        value = F.struct(F.when(deleted, None).otherwise(F.col("source")).alias("source"), F.when(deleted, None).otherwise(F.col("lang")).alias("lang"), F.when(deleted, None).otherwise(F.col("n_tokens")).alias("n_tokens"))
        rank = F.struct("seq", "n_tokens", "source", "lang")
        new = given.groupBy("doc_id", "tokenizer").agg(F.max_by(value, rank).alias("new"))
        folder = f"{self.root}/batch={batch}"
        rows = new.select("doc_id", "new.source", "new.lang", "tokenizer", "new.n_tokens", F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{folder}/ledger")
        put = self.spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
        inserted = put.where("n_tokens IS NOT NULL").select(*KEYS, F.lit(1).alias("sign"), "n_tokens")
        # only the rows of the batch's documents are aggregated, however long the ledger is
        old = self.ledger(done, put.select("doc_id", "tokenizer"))
        removed = old.select("source", "lang", "tokenizer", F.lit(-1).alias("sign"), "n_tokens")
        signed = inserted.unionByName(removed)
        # few groups whatever the input: partial sums leave each task as one row a group, so a hot source is no hot task
        sums = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{folder}/totals")
        self._mark("commits", batch)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version; groups without documents are left out."""
        rows = self._read("totals", TOTALS, self.committed())
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")
