"""Keyed tables as bucketed deltas with tombstones, and event tables as committed appends.

    <root>/rows/delta_version=<n>/delta_bucket=<b>    the rows that version n wrote
    <root>/keys/delta_version=<n>/delta_bucket=<b>    the keys that version n replaced or removed
    <root>/commits/<n>                    a snapshot: which versions make up each bucket

A commit writes only the buckets of the keys that it touches.  Its snapshot, a
small JSON file, is renamed into place last: until then readers see the version
before it, and what a failed commit has left is written anew by the next one.
Readers merge: a row counts unless a later version of its bucket has touched its
key.  Buckets of one version are read without any join; of the others only the
touched keys are joined, and Spark broadcasts these by their measured size or
sorts both sides.  A bucket of too many versions is compacted by itself, in a
commit of its own.

A commit may carry a write id; an id that is among the last ones is not written
again, so a step that is repeated after a failure counts once.  There is one
writer at a time: a commit whose number is taken meanwhile is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


class Commits:
    """Numbered snapshots (JSON) below a folder; the last one counts."""

    #: Snapshots that stay readable, and write ids that are remembered.
    KEPT, IDS = 2, 200

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def names(self, folder: str) -> list[str]:
        fs, place = self.path(folder)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def delete(self, name: str) -> None:
        fs, place = self.path(name)
        fs.delete(place, True)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.names("commits") if n.isdigit())

    def read(self, number: int) -> dict:
        fs, place = self.path(f"commits/{number}")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """Number and snapshot of the last commit; (-1, {}) without one."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def publish(self, number: int, snapshot: dict, write_id: str | None) -> None:
        """Makes a snapshot the last one; it remembers the write ids of those before it."""
        _, before = self.last()
        ids = [*before.get("ids", []), *([write_id] if write_id else [])][-self.IDS :]
        fs, draft = self.path(f"commits/.{number}-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({**snapshot, "ids": ids}).encode()))
        finally:
            out.close()
        _, place = self.path(f"commits/{number}")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"version {number} of {self.root} was written by someone else meanwhile")

    def known(self, write_id: str | None) -> bool:
        return write_id is not None and write_id in self.last()[1].get("ids", [])


class DeltaTable:
    """A table whose rows are replaced and removed by key; all rows of a key belong together.

    ``buckets`` is fixed when the table is made: a commit rewrites nothing, and a
    compaction one bucket, so take as many as make a bucket a task's work.  A null
    key is a key like others.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64, most_versions: int = 8):
        self.spark, self.key, self.most = spark, key, most_versions
        self.log = Commits(spark, root)
        self.root = self.log.root
        self.buckets = self.log.last()[1].get("buckets", buckets)

    def exists(self) -> bool:
        return self.log.last()[0] >= 0

    def version(self) -> int:
        return self.log.last()[0]

    # ------------------------------------------------------------ reading

    def _read(self, kind: str, parts: Iterable[tuple[int, int]], schema: T.StructType) -> DataFrame:
        """Rows of (version, bucket) parts, with these as columns; versions of which every bucket is asked for are one path."""
        own = T.StructType([*schema.fields, T.StructField("delta_version", T.LongType()), T.StructField("delta_bucket", T.IntegerType())])
        asked: dict[int, list[int]] = {}
        for v, b in parts:
            asked.setdefault(v, []).append(b)
        paths = []
        for v, some in asked.items():
            there = {int(n.partition("=")[2]) for n in self.log.names(f"{kind}/delta_version={v}") if n.startswith("delta_bucket=")}
            some = set(some) & there
            paths += [f"{self.root}/{kind}/delta_version={v}"] if some == there and there else [f"{self.root}/{kind}/delta_version={v}/delta_bucket={b}" for b in sorted(some)]
        if not paths:
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def read(self, number: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """The live rows of the last (or one of the last) versions, of all or some buckets; None where there is no table."""
        n, snapshot = self.log.last() if number is None else (number, self.log.read(number))
        if n < 0:
            return None
        schema = T.StructType.fromJson(snapshot["schema"])
        only = None if buckets is None else set(buckets)
        parts = {int(b): v for b, v in snapshot["parts"].items() if only is None or int(b) in only}
        single = [(v[0], b) for b, v in parts.items() if len(v) == 1]
        several = {b: v for b, v in parts.items() if len(v) > 1}
        rows = self._read("rows", single, schema).select(schema.names)
        if not several:
            return rows
        return rows.unionByName(self._merged(several, schema).select(schema.names))

    def _merged(self, parts: dict[int, list[int]], schema: T.StructType) -> DataFrame:
        """The live rows of buckets of several versions."""
        key = T.StructType([schema[self.key]])
        touched = self._read("keys", [(v, b) for b, vs in parts.items() for v in vs[1:]], key)
        last = touched.groupBy("delta_bucket", c(self.key).alias("_key")).agg(F.max("delta_version").alias("_last"))
        rows = self._read("rows", [(v, b) for b, vs in parts.items() for v in vs], schema)
        merged = rows.join(last.withColumnRenamed("delta_bucket", "_bucket"), (c("delta_bucket") == c("_bucket")) & c(self.key).eqNullSafe(c("_key")), "left")
        return merged.where(c("_last").isNull() | (c("delta_version") >= c("_last")))

    def changed_buckets(self, since: int) -> list[int]:
        """Buckets that a version after ``since`` has touched."""
        return sorted(int(b) for b, v in self.log.last()[1].get("parts", {}).items() if v[-1] > since)

    # ------------------------------------------------------------ writing

    def _bucket(self) -> F.Column:
        return F.pmod(F.hash(c(self.key)), F.lit(self.buckets)).alias("delta_bucket")

    def _write(self, kind: str, number: int, rows: DataFrame, order: str | None = None) -> None:
        """Rows by bucket; AQE splits what is too large for one file's task and joins small ones."""
        self.log.delete(f"{kind}/delta_version={number}")
        rows = rows.hint("rebalance", c("delta_bucket"))
        rows = rows.sortWithinPartitions("delta_bucket", order) if order else rows
        rows.write.partitionBy("delta_bucket").parquet(f"{self.root}/{kind}/delta_version={number}")

    def commit(self, rows: DataFrame | None = None, gone: DataFrame | None = None, write_id: str | None = None, whole: bool = False, order: str | None = None) -> int:
        """Replaces all rows of the keys in ``rows`` by these, and removes those of the keys in ``gone``; ``whole`` replaces the table.

        Files are sorted by ``order``, so that readers who filter by it skip most of their pages.

        Returns the number of the version, the last one's if there was nothing to do.  A commit is merged with what
        compaction it makes due.
        """
        number, before = self.log.last()
        if self.log.known(write_id) or rows is None and gone is None:
            return number
        number += 1
        if rows is None and not before:
            return number - 1
        schema = T.StructType.fromJson(before["schema"]) if rows is None else rows.schema
        keys = None if gone is None else gone.select(self.key)
        if rows is not None:
            self._write("rows", number, rows.select("*", self._bucket()), order)
            # the keys of what was written: the plan of the rows runs once
            own = T.StructType([schema[self.key]])
            written = self.spark.read.schema(own).option("recursiveFileLookup", True).parquet(f"{self.root}/rows/delta_version={number}")
            keys = written if keys is None else keys.unionByName(written)
        self._write("keys", number, keys.distinct().select(self.key, self._bucket()))
        touched = {int(n.partition("=")[2]) for kind in ("keys", "rows") for n in self.log.names(f"{kind}/delta_version={number}") if n.startswith("delta_bucket=")}
        if not touched and not whole and before:
            self._discard(number)
            return number - 1
        parts = {} if whole else {int(b): v for b, v in before.get("parts", {}).items()}
        for b in touched:
            parts[b] = [*parts.get(b, []), number]
        self._publish(number, parts, schema, write_id)
        if due := [b for b, v in parts.items() if len(v) > self.most]:
            self.compact(due)
        return self.version()

    def compact(self, buckets: Iterable[int] | None = None) -> int:
        """Rewrites buckets of several versions as one; the others are not read."""
        number, before = self.log.last()
        parts = {int(b): v for b, v in before.get("parts", {}).items()}
        due = {b: v for b, v in parts.items() if len(v) > 1 and (buckets is None or b in set(buckets))}
        if not due:
            return number
        number += 1
        schema = T.StructType.fromJson(before["schema"])
        self._write("rows", number, self._merged(due, schema).select(*schema.names, "delta_bucket"))
        there = {int(n.partition("=")[2]) for n in self.log.names(f"rows/delta_version={number}") if n.startswith("delta_bucket=")}
        for b in due:
            if b in there:
                parts[b] = [number]
            else:
                del parts[b]  # nothing of it is left
        self._publish(number, parts, schema, None)
        return number

    def _publish(self, number: int, parts: dict[int, list[int]], schema: T.StructType, write_id: str | None) -> None:
        self.log.publish(number, {"buckets": self.buckets, "schema": schema.jsonValue(), "parts": {str(b): v for b, v in parts.items()}}, write_id)
        self._forget()

    def _discard(self, number: int) -> None:
        for kind in ("rows", "keys"):
            self.log.delete(f"{kind}/delta_version={number}")

    def _forget(self) -> None:
        """Drops snapshots older than the last ones, and the parts that only these have."""
        numbers = self.log.numbers()
        stay = {(int(b), v) for n in numbers[-Commits.KEPT :] for b, vs in self.log.read(n)["parts"].items() for v in vs}
        versions = {v for _, v in stay}
        for n in numbers[: -Commits.KEPT]:
            old = {(int(b), v) for b, vs in self.log.read(n)["parts"].items() for v in vs} - stay
            for v in {v for _, v in old} - versions:
                self._discard(v)
            for b, v in old:
                if v in versions:
                    for kind in ("rows", "keys"):
                        self.log.delete(f"{kind}/delta_version={v}/delta_bucket={b}")
            self.log.delete(f"commits/{n}")


class AppendLog:
    """A table to which whole frames are appended, each under a write id that counts once.

    Readers take committed writes only.  Small writes are merged into one when there are many.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, most_writes: int = 64):
        self.spark, self.schema, self.most = spark, schema, most_writes
        self.log = Commits(spark, root)
        self.root = self.log.root

    def read(self) -> DataFrame:
        _, snapshot = self.log.last()
        paths = [f"{self.root}/rows/write={w}" for w in snapshot.get("writes", [])]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.select(self.schema.names)

    def append(self, rows: DataFrame, write_id: str | None = None) -> bool:
        """Appends a frame; False where its write id was appended before."""
        if self.log.known(write_id):
            return False
        number, before = self.log.last()
        number += 1
        self.log.delete(f"rows/write={number}")
        rows.write.parquet(f"{self.root}/rows/write={number}")
        self.log.publish(number, {"writes": [*before.get("writes", []), number]}, write_id)
        if len(before.get("writes", [])) + 1 > self.most:
            self.merge()
        self._forget()
        return True

    def merge(self) -> None:
        """Writes all small writes as one, in files of the size that AQE takes for a task."""
        number, before = self.log.last()
        number += 1
        self.log.delete(f"rows/write={number}")
        self.read().hint("rebalance").write.parquet(f"{self.root}/rows/write={number}")
        self.log.publish(number, {"writes": [number]}, None)

    def _forget(self) -> None:
        numbers = self.log.numbers()
        stay = {w for n in numbers[-Commits.KEPT :] for w in self.log.read(n)["writes"]}
        for n in numbers[: -Commits.KEPT]:
            for w in set(self.log.read(n)["writes"]) - stay:
                self.log.delete(f"rows/write={w}")
            self.log.delete(f"commits/{n}")
