"""Exact vector search that reads only the cells that can hold a hit.

Vectors are scaled to length one and dealt to the nearest of a few centres; a
cell keeps its centre and its radius, the largest distance of a member.  By the
triangle inequality no member of a cell is nearer to a question than the
distance to the centre less the radius.  A search reads the best cells until it
has k vectors, which bounds the distance of the k-th hit, and then those further
cells whose bound is not beyond it.  Scores come from the same expression as the
scan's, over fewer rows, so results are equal.

    <path>/rows/cell=<c>    the vectors of a cell, all columns
    <path>/schema           the vectors' columns, as JSON
    <path>/cells            (cell, centre, radius, n), written last

Centres are fitted on a bounded sample; they affect how much is read, never what
is found.  Vectors of another length than most or of length zero score nothing
and lie in cell -1, which is never read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.operators.retrieval import Question, vector_search
from loomlake.runtime import ensure_package

#: Cells of an index, vectors that their centres are fitted on at most, and rounds of the fit.
CELLS, SAMPLE, ROUNDS = 64, 10_000, 8
#: Rounding of distances.
MARGIN = 1e-5
NOWHERE = -1


def unit(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the given length scaled to length one, and which rows they are."""
    own = [i for i, v in enumerate(rows) if v is not None and len(v) == dims and not any(x is None for x in v)]
    m = np.array([np.asarray(rows[i], dtype=np.float64) for i in own]).reshape(len(own), dims)
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return m[good] / norm[good][:, None], np.array(own, dtype=np.int64)[good]


def fit(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Centres of length one: begun at spread-out vectors, then moved to the mean of what is nearest to them."""
    if not len(sample):
        return sample
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(cells, len(sample)) and near.min() < 1 - MARGIN:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    centres = sample[picked]
    for _ in range(ROUNDS):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def build(vectors: DataFrame, path: str, column: str = "embedding", key: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE) -> None:
    """Writes the index of vectors; the sample is chosen by hash of the key."""
    spark = vectors.sparkSession
    ensure_package(spark)
    n = vectors.count()
    share = min(1.0, sample / max(1, n))
    unit_hash = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = [r[0] for r in vectors.where(unit_hash < share).select(F.col(column).cast("array<double>")).limit(2 * sample).collect()]
    lengths = [len(v) for v in some if v is not None]
    dims = max(set(lengths), key=lengths.count) if lengths else 0
    centres = fit(unit(some, dims)[0], cells)
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*vectors.schema.fields, T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        for batch in batches:
            cell, far = np.full(len(batch), NOWHERE, dtype=np.int32), np.zeros(len(batch))
            if len(centres):
                v, own = unit(batch[column].tolist(), centres.shape[1])
                near = v @ centres.T
                cell[own] = near.argmax(axis=1)
                far[own] = np.linalg.norm(v - centres[cell[own]], axis=1)
            yield batch.assign(far=far, cell=cell)

    vectors.mapInPandas(deal, schema).hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    found = rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).where(F.col("cell") != NOWHERE)
    where = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    where.join(found, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


class VectorIndex:
    """An index that was built at a path."""

    def __init__(self, spark: SparkSession, path: str, column: str = "embedding"):
        self.spark, self.path, self.column = spark, path, column
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema", wholetext=True).first().value))
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")
        known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many as cells
        self.cells = [r.cell for r in known]
        self.sizes = {r.cell: r.n for r in known}
        self.radius = np.array([r.radius for r in known])
        self.centres = np.array([r.centre for r in known])

    def bounds(self, q: Question) -> np.ndarray:
        """For each cell the least distance that a member may have to the question."""
        v = np.asarray(q.vector, dtype=np.float64)
        if not len(self.cells) or len(v) != self.centres.shape[1] or not np.linalg.norm(v) > 0:
            return np.full(len(self.cells), np.inf)  # such a question has no hits
        return np.maximum(0.0, np.linalg.norm(self.centres - v / np.linalg.norm(v), axis=1) - self.radius - MARGIN)

    def of(self, cells: set[int]) -> DataFrame:
        return self.rows.where(F.col("cell").isin(sorted(cells)) if cells else F.lit(False)).drop("far", "cell")

    def needed(self, questions: list[Question], k: int) -> set[int]:
        """The cells that hold all best k hits of the questions."""
        bounds = {q.query_id: self.bounds(q) for q in questions}
        first: set[int] = set()
        for b in bounds.values():
            held = 0
            for i in np.argsort(b, kind="stable"):
                if held >= k or not np.isfinite(b[i]):
                    break
                first.add(self.cells[i])
                held += self.sizes[self.cells[i]]
        hits = vector_search(self.of(first), questions, k, self.column).where(F.col("rank") == k).select("query_id", "score").collect()
        last = {r.query_id: r.score for r in hits}
        out = set(first)
        for q, b in bounds.items():
            # hits have a positive score, so they are nearer than the root of 2
            reach = sqrt(max(0.0, 2 - 2 * last[q])) if q in last else sqrt(2)
            out |= {self.cells[i] for i in np.flatnonzero(b <= reach + MARGIN)}
        return out

    def search(self, questions: list[Question], k: int) -> DataFrame:
        """What ``vector_search`` gives over all vectors."""
        return vector_search(self.of(self.needed(questions, k)), questions, k, self.column)

    def share(self, questions: list[Question], k: int) -> float:
        """Share of the vectors that a search reads."""
        return sum(self.sizes[c] for c in self.needed(questions, k)) / max(1, sum(self.sizes.values()))
