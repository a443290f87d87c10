"""Shared pieces: table access, folds, shared storage and vectorised text views.

Texts are handled as the UTF-8 bytes of whole Arrow batches.  ``TextBatch``
exposes a batch as one byte array plus offsets, and walks it in runs of whole
documents of a few MB, so that temporaries stay small whatever the batch size.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.runtime import ensure_package

#: Bytes that separate words: space and the five controls 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of a run of documents that is handled at once.
RUN_BYTES = 1 << 20

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a test-data directory with only the columns asked for."""
    ensure_package(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id falls in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    A temporary folder is set only where the session names none (local tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and returns it reread: a recoverable lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of one run below the shared one, removed with its tables when the run ends.

    The shuffles of a step are removed with it: what later steps read is stored.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/loomlake/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.before: dict[str, str | None] = {}
        self.set(self.CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        self.drop()

    def set(self, key: str, value: str) -> None:
        """Sets a value of the session until the run ends."""
        self.before.setdefault(key, self.spark.conf.get(key, None))
        self.spark.conf.set(key, value)

    def partitions(self, least: int) -> None:
        """Shuffles have so many partitions at least, so that a task's share does not grow with the input."""
        key = "spark.sql.shuffle.partitions"
        self.set(key, str(max(least, int(self.spark.conf.get(key)))))

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a frame below the folder and returns it reread."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables, or the whole folder."""
        jvm = self.spark._jvm
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(frame: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow that gives a task's free memory back: workers are kept from stage to stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return frame.mapInArrow(run, schema)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 1)
        with np.errstate(over="ignore"):
            out = []
            for base in (_R, _R_INVERSE):
                a = np.full(size, base, dtype=np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        if size > 4 * RUN_BYTES:  # for one very long text: used once, not kept
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


class Run:
    """A run of whole documents: bytes, and where each begins (with the end as last entry)."""

    __slots__ = ("data", "first", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each document the index of its first word (n+1 entries)."""
        data = self.data if data is None else data
        inside = ~SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = self.offsets[:-1][self.offsets[:-1] < len(data)]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        ends[last] |= inside[last]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return starts, stops, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, stops: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (polynomial, then mixed)."""
        data = self.data if data is None else data
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            return mix((sums[stops] - sums[starts]) * down[starts])


class TextBatch:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        n = len(column)
        buffers = column.buffers()
        self.offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def runs(self, limit: int = RUN_BYTES) -> Iterator[Run]:
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + limit, side="right")) - 1)
            a, b = self.offsets[i], self.offsets[j]
            yield Run(self.data[a:b], self.offsets[i : j + 1] - a, i)
            i = j
