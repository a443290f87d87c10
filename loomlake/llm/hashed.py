"""Hashed n-gram features of text batches and linear models over them.

A document's vector has a block of word buckets and a block of byte-n-gram
buckets, each holding relative frequencies, so texts of any length compare.
Scoring never builds the vector: the weights of all n-grams are gathered for a
run of documents and summed by document with prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import Run, TextBatch, map_batches


@dataclass(frozen=True)
class Space:
    """Shape of the feature space: buckets of each block, n-gram sizes, and a byte map applied first."""

    word_bits: int = 12
    gram_bits: int = 12
    grams: tuple[int, ...] = (3,)
    byte_map: bytes | None = None

    @property
    def words(self) -> int:
        return 1 << self.word_bits if self.word_bits else 0

    @property
    def size(self) -> int:
        return self.words + (1 << self.gram_bits) * len(self.grams)


def _sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[begins:ends] for each pair."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[np.maximum(ends, begins)] - total[begins]


def blocks(run: Run, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block the feature of every n-gram of a run, and each document's first and last+1 n-gram."""
    data = np.frombuffer(space.byte_map, np.uint8)[run.data] if space.byte_map else run.data
    if space.words:
        starts, stops, first = run.words(data)
        yield (run.word_hashes(starts, stops, data) >> np.uint64(64 - space.word_bits)).astype(np.int64), first[:-1], first[1:]
    wide = data.astype(np.uint32)
    for k, n in enumerate(space.grams):
        h = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for j in range(n):
                h *= np.uint32(0x01000193)
                h += wide[j : j + len(h)] + np.uint32(1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
        begins = np.minimum(run.offsets[:-1], len(h))
        ends = np.minimum(np.maximum(run.offsets[1:] - n + 1, begins), len(h))
        yield (h >> np.uint32(32 - space.gram_bits)).astype(np.int64) + space.words + (k << space.gram_bits), begins, ends


def linear_scores(run: Run, space: Space, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of a run's documents under one or several linear models (features x models)."""
    out = np.tile(np.asarray(bias, dtype=np.float64), (len(run), 1))
    for features, begins, ends in blocks(run, space):
        if len(features):
            counts = np.maximum(ends - begins, 1)[:, None]
            out += _sums(weights[features], begins, ends) / counts
    return out


def vectors(run: Run, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document of a run the features present and their relative frequencies."""
    parts = list(blocks(run, space))
    for i in range(len(run)):
        idx, val = [], []
        for features, begins, ends in parts:
            own = features[begins[i] : ends[i]]
            if len(own):
                k, c = np.unique(own, return_counts=True)
                idx.append(k)
                val.append(c / len(own))
        yield (np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)) if idx else (np.zeros(0, np.int32), np.zeros(0, np.float32))


#: Bytes of a run of documents whose n-grams are held at once; arrays over these take many times as much.
RUN_BYTES = 1 << 18
#: Label values whose shares are broadcast at most.
BROADCAST_LABELS = 100_000


def agreed_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """__id and __label (0/1) of every id whose labels all say the same; null ids and null labels do not count."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    own = known.groupBy(F.col(key).alias("__id")).agg(F.min(F.col(label) > 0).alias("lo"), F.max(F.col(label) > 0).alias("hi"))
    return own.where("lo = hi").select("__id", F.col("lo").cast("int").alias("__label"))


def bounded_sample(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """Rows of each label whose hashed key falls under that label's share, about most / n_labels of each.

    The share is found from counts over all rows, so the choice is the same however
    the rows are partitioned and no label's rows meet in one task.  A row without
    a key is not chosen.  All rows of one key are chosen or none is; ``one_text``
    leaves one of them, so repeated keys do not stretch the bound.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(label).alias("__of")).agg(F.count("*").alias("__n"))
    few = counts.limit(BROADCAST_LABELS).toArrow()
    labels = few.num_rows
    if not labels:
        return rows.limit(0)
    if labels < BROADCAST_LABELS:  # a row for each label, so many at most: rows stay in their scan; an Arrow table needs no Python worker
        counts = F.broadcast(rows.sparkSession.createDataFrame(few, counts.schema))
    else:
        labels = counts.count()
    share = counts.select("__of", F.least(F.lit(1.0), F.lit(most / labels) / F.col("__n")).alias("__share"))
    unit = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.join(share, F.col(label) == F.col("__of")).where(unit < F.col("__share")).select(rows.columns)


def one_text(rows: DataFrame) -> DataFrame:
    """Of each __id with a __label the last of its texts in order; tasks send one row for each id on."""
    return rows.groupBy("__id", "__label").agg(F.max("__text").alias("__text"))


def collect_vectors(rows: DataFrame, text: str, label: str, space: Space, most: int) -> tuple[np.ndarray, list]:
    """Dense feature matrix and labels of a bounded sample, never more than 2 * ``most`` rows; texts are reduced to features on the executors."""

    def run(batches):
        for batch in batches:
            texts = TextBatch(batch.column(0))
            idx, val = [], []
            for r in texts.runs(RUN_BYTES):
                for i, v in vectors(r, space):
                    idx.append(i.tobytes())
                    val.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["label", "idx", "val"])

    frame = rows.select(F.col(text).alias("text"), F.col(label).alias("label"))
    kind = dict(frame.dtypes)["label"]
    got = map_batches(frame, run, f"label {kind}, idx binary, val binary").orderBy("label", "idx", "val").limit(2 * most).collect()
    x = np.zeros((len(got), space.size), dtype=np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r[1], np.int32)] = np.frombuffer(r[2], np.float32)
    return x, [r[0] for r in got]


def fit_linear(x: np.ndarray, y: np.ndarray, loss: str, l2: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """A balanced linear model for labels +1/-1: 'logistic' or 'squared_hinge' loss, accelerated gradient descent.

    Columns are scaled to unit root mean square while fitting, in place: x must be the caller's own copy.
    The weights returned fit raw features.
    """
    n = len(x)
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / max(1, n))
    scale = np.where(scale > 0, 1.0 / np.maximum(scale, 1e-6), 0.0).astype(np.float32)
    z = x
    z *= scale
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    v = np.random.default_rng(0).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(12):  # largest curvature, by power iteration
        v /= max(1e-12, float(np.linalg.norm(v)))
        v = z.T @ (share * (z @ v))
    curvature = (float(np.linalg.norm(v)) + 1.0) * (0.25 if loss == "logistic" else 2.0) + l2
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        m = (t - 1) / nt
        aw, ab, t = w + m * (w - pw), b + m * (b - pb), nt
        margin = y * (z @ aw + ab)
        g = -y / (1 + np.exp(np.clip(margin, -30, 30))) if loss == "logistic" else -2 * y * np.maximum(0, 1 - margin)
        g = (share * g).astype(np.float32)
        pw, pb = w, b
        w, b = aw - (z.T @ g + l2 * aw) / curvature, ab - float(g.sum()) / curvature
    return (w * scale).astype(np.float32), float(b) if n else 0.0


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities of label 1 (Platt's smoothed targets, Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = max(float(score.std()), 1e-9)
    s = score / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        d, w = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * s).sum() + 1e-3 * a, d.sum()])
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a / spread, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
