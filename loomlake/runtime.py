"""Makes the package importable in Python workers, wherever they run, names the folder that executors share, bounds batches and cuts them into pieces."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of a batch that are turned into Python objects at once.
PIECE_BYTES = 1 << 20
#: Bytes of a batch that Spark sends to a Python worker (or one row); its own bound is 64 MB, which every core holds several times over.
BATCH_BYTES = 4 << 20
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Ships this package to the session's executors, once for each application, and bounds the session's Arrow batches where it names no bound."""
    if spark.conf.get(BATCH_BOUND, None) is None:
        spark.conf.set(BATCH_BOUND, f"{BATCH_BYTES}b")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # not when it was itself imported from a shipped archive
        target = Path(tempfile.mkdtemp(prefix="loomlake-")) / "loomlake.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one is set only in local sessions that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, as slices of at most ``most`` bytes or one row; free memory goes back behind each batch.

    Spark's batches are bounded by rows and by ``BATCH_BYTES``; what is made of a row can be many times its bytes.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        texts = [x for x in batch.columns if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) or pa.types.is_binary(x.type) or pa.types.is_large_binary(x.type)]
        n = batch.num_rows
        size = np.full(n, max(0, batch.nbytes - sum(x.nbytes for x in texts)) / max(1, n))
        for x in texts:
            size += pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0.0], np.cumsum(size)])
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to
        del batch, texts
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)
