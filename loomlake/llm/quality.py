"""Quality rules: exact base measures, then a calibrated hashed n-gram classifier.

``measure`` counts, for every whole text, words ([^\\x20\\x09-\\x0D]+), code
points in words, symbols, duplicate lines and words in repeated three-word
windows.  ``train`` fits a logistic regression over hashed words and byte
trigrams on a bounded sample of labelled rows and calibrates its probabilities
on a part of the sample that the fit does not see.  ``apply`` scores Arrow
batches and keeps a document if it passes the base rules and its probability of
good quality reaches the fixed threshold.

Null and empty texts have no words, fail the base rules and are not kept.
Null labels, labels of null ids and ids whose labels contradict each other are not
learned from; of several texts of one id the last in order is.  Where no row, or only one class, is labelled,
the classifier gives every text probability 1 and only the base rules decide.
Repeated words and lines are compared by 64-bit hash and by bytes respectively.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import Run, SPACE, TextBatch, map_batches, mix
from loomlake.llm.hashed import RUN_BYTES, Space, agreed_labels, bounded_sample, collect_vectors, fit_linear, linear_scores, one_text, platt, sigmoid

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A document is kept from this probability of good quality on.
KEEP_AT = 0.5
#: Labelled rows that the classifier is fitted on at most (about half of each class), and the features.
SAMPLE_ROWS = 2400
FEATURES = Space(word_bits=12, gram_bits=12, grams=(3,))

_symbol = np.zeros(256, dtype=bool)
_symbol[list(SYMBOLS)] = True
_in_word = ~SPACE
_in_word[0x80:0xC0] = False


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the number of words in three-word windows that it has twice or more."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(first) - 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        key = mix(mix(mix(hashes[:-2] + doc[:-2].astype(np.uint64)) * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    key = key[whole]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = whole[order[twice]]
    covered = np.zeros(n, dtype=bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(doc[covered], minlength=len(first) - 1)


def base_measures(run: Run) -> dict[str, np.ndarray]:
    starts, stops, first = run.words()
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[run.offsets])
    lines = []
    buf = run.data.tobytes()
    for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist()):
        own = [x for x in buf[a:b].split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": np.diff(first),
        "word_chars": count(_in_word[run.data]),
        "n_symbols": count(_symbol[run.data]),
        "n_dup_lines": np.array(lines, dtype=np.int64),
        "n_repeat_words": repeated_words(run.word_hashes(starts, stops), first),
    }


@dataclass(frozen=True)
class Model:
    space: Space
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, run: Run) -> np.ndarray:
        return sigmoid(self.slope * linear_scores(run, self.space, self.weights[:, None], np.array([self.bias]))[:, 0] + self.shift)


def fit(x: np.ndarray, y: np.ndarray, space: Space = FEATURES) -> Model:
    """Fits on three quarters of the rows and calibrates on the rest."""
    y = np.where(np.asarray(y) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(space, np.zeros(space.size, np.float32), 0.0, 0.0, 40.0)
    order = np.random.default_rng(0).permutation(len(y))
    own, rest = order[len(y) // 4 :], order[: len(y) // 4]
    if len(set(y[own].tolist())) < 2:
        own = rest = order
    w, b = fit_linear(x[own], y[own], "logistic")
    slope, shift = platt(x[rest] @ w + b, y[rest])
    return Model(space, w, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """Fits the classifier on at most about ``rows`` labelled documents, chosen by hash of their id."""
    sample = bounded_sample(agreed_labels(labels, key, label), "__label", "__id", rows)
    # the sample has at most about `rows` rows of two numbers: a proven bound
    joined = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id")
    x, y = collect_vectors(one_text(joined), "__text", "__label", FEATURES, rows)
    return fit(x, np.array(y))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def apply(docs: DataFrame, model: Model, text: str = "text", threshold: float = KEEP_AT) -> DataFrame:
    """All columns of ``docs`` with the base measures, base_failed, quality_score and kept; same-named columns are replaced."""
    new = [T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + new)
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [base_measures(r) | {"p": model.probability(r)} for r in TextBatch(batch.column(batch.num_columns - 1)).runs(RUN_BYTES)]
            col = {m: np.concatenate([p[m] for p in parts]) if parts else np.zeros(0) for m in [*MEASURES, "p"]}
            failed = (col["n_words"] < LEAST_WORDS) | (100 * col["n_repeat_words"] > MOST_REPEATED_PERCENT * col["n_words"])
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays += [pa.array(col[m].astype(np.int64)) for m in MEASURES]
            arrays += [pa.array(failed.astype(bool)), pa.array(col["p"].astype(np.float64)), pa.array(~failed.astype(bool) & (col["p"] >= threshold))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(frame, run, schema)
