"""Toxicity with a convolutional text classifier, in numpy.

A word (a run of ASCII letters and digits and of non-ASCII bytes, A-Z lower-
cased) is embedded as the sum of two rows: one picked by a hash of the word, one
by a hash of its first PREFIX bytes, so that inflected and new forms of a word
share a row and words that collide in one table still differ.  Filters one, two and three words wide
slide over the embeddings; the largest response of each filter over the text
feeds a logistic output.  Training walks bounded labelled rows in small batches
with Adagrad; because of the max pooling only the winning windows get
gradients.

The decision threshold is calibrated for each language group on labelled rows
that the fit does not see.  The group is found from the text alone, by its
function words.  Scores are shifted so that 0.5 is the group's threshold.

For scoring, embedding and filters are multiplied out once: a word's row holds
its share in each position of each filter, and a window's response is a sum of
gathered numbers.  Empty and null texts are scored like a text of padding only.
Null labels, labels of null ids and ids whose labels contradict each other are not
learned from; of several texts of one id the last in order is, if it has
SAMPLE_WORDS words or fewer.  With fewer than two classes every score is 0.  A
language group with fewer than five held rows of a class has the threshold of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import FOLD, Run, TextBatch, map_batches
from loomlake.llm.hashed import agreed_labels, bounded_sample, one_text, platt, sigmoid

BITS, WIDTH, FILTERS, SIZES = 16, 8, 8, (1, 2, 3)
#: Labelled rows that the network is fitted and calibrated on at most (about half of each class), and passes over them.
SAMPLE_ROWS, PASSES = 4000, 20
#: Words of a text that is learned from, at most: with SAMPLE_ROWS this bounds what comes to the driver.
SAMPLE_WORDS = 8000
#: Bytes of a word that pick its second row.
PREFIX = 4
#: Step of plain gradient descent on embeddings: a rare word moves little, however rarely it is seen.
EMBEDDING_RATE = 0.05
#: Standard errors within which a word's difference between the classes counts as chance.
NOISE = 3.0
#: Function words by which a text's language group is told.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for with was this are from by have not",
    "de": "der die und das ist nicht mit ein zu auf für von den eine sich dem auch",
    "fr": "le les et des est une du que dans pour pas sur qui avec au ce aux",
    "es": "el los y las es una por con para del se como más pero su al lo",
}
GROUPS = [*FUNCTION_WORDS, "other"]

_MAP = np.full(256, 0x20, dtype=np.uint8)
_MAP[48:58] = np.arange(48, 58)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_MAP = _MAP[FOLD]
_COLUMNS = [(k, j) for k, size in enumerate(SIZES) for j in range(size)]


def _hashes(words: list[str]) -> np.ndarray:
    b = np.frombuffer(" ".join(words).encode(), np.uint8)
    return word_hashes(Run(b, np.array([0, len(b)]), 0))[0]


def _function_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(h), g) for g, words in enumerate(FUNCTION_WORDS.values()) for h in _hashes(words.split()))
    return np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs])


def word_hashes(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a run 32 bits of its hash above 32 bits of its prefix's, and each document's first word (n+1 entries)."""
    data = _MAP[run.data]
    starts, stops, first = run.words(data)
    word = run.word_hashes(starts, stops, data)
    prefix = run.word_hashes(starts, np.minimum(stops, starts + PREFIX), data)
    return (word >> np.uint64(32) << np.uint64(32)) | (prefix >> np.uint64(32)), first


def groups(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Language group of each document by most function words; none or a tie of none: other."""
    known, group = _function_table()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.zeros((len(first) - 1, len(GROUPS)), dtype=np.int64)
    np.add.at(counts, (doc[hit], group[at[hit]]), 1)
    best = counts.argmax(axis=1)
    return np.where(counts.max(axis=1) > 0, best, len(GROUPS) - 1)


def padded(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both tables for each word, with padding rows (1 << BITS) behind each document, and where documents begin."""
    n, pad = len(first) - 1, max(SIZES) - 1
    at = np.arange(len(hashes)) + pad * np.repeat(np.arange(n), np.diff(first))
    size = len(hashes) + pad * n
    a = np.full(size, 1 << BITS, dtype=np.int64)
    b = a.copy()
    a[at] = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    b[at] = (hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return a, b, first[:-1] + pad * np.arange(n)


@dataclass
class Model:
    table_a: np.ndarray  # rows x (filter positions * FILTERS): a word's share in each filter position
    table_b: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slopes: np.ndarray
    thresholds: np.ndarray
    trained: bool = True

    def logits(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = word_hashes(run)
        a, b, begins = padded(hashes, first)
        share = self.table_a[a]
        share += self.table_b[b]
        n, hidden = len(a), []
        for k, size in enumerate(SIZES):
            cols = [c for c, (kk, _) in enumerate(_COLUMNS) if kk == k]
            response = share[:, cols[0] * FILTERS : (cols[0] + 1) * FILTERS].copy()
            for j in range(1, size):
                response[: n - j] += share[j:, cols[j] * FILTERS : (cols[j] + 1) * FILTERS]
            hidden.append(np.maximum.reduceat(response, begins, axis=0))
        h = np.maximum(np.concatenate(hidden, axis=1) + self.bias, 0)
        return h @ self.out + self.shift, groups(hashes, first)

    def scores(self, run: Run) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(run))
        z, g = self.logits(run)
        return sigmoid(self.slopes[g] * (z - self.thresholds[g]))


def word_evidence(texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """For each row of both tables how far its document frequency differs between the classes, in tens of standard errors beyond NOISE.

    The first embedding dimension starts from it, so that the network begins with the
    words that tell the classes apart and rare words begin near 0.
    """
    out = []
    for pick in (lambda h: h >> np.uint64(64 - BITS), lambda h: h & np.uint64((1 << BITS) - 1)):
        seen = np.zeros((2, 1 << BITS))
        for h, label in zip(texts, y):
            seen[int(label > 0), np.unique(pick(h)).astype(np.int64)] += 1
        n = np.array([(y <= 0).sum(), (y > 0).sum()], dtype=float)
        p = (seen.sum(axis=0) + 1) / (n.sum() + 2)
        error = np.sqrt(p * (1 - p) * (1 / n).sum())
        z = (seen[1] / n[1] - seen[0] / n[0]) / error
        out.append((np.sign(z) * np.maximum(np.abs(z) - NOISE, 0) / 10).astype(np.float32))
    return out


def fit(texts: list[np.ndarray], y: np.ndarray, group: np.ndarray, passes: int = PASSES, seed: int = 0) -> Model:
    """Trains the network on three quarters of the rows (arrays of word hashes) and calibrates on the rest."""
    y = np.asarray(y, dtype=np.float32)
    rng = np.random.default_rng(seed)
    rows, nf = 1 << BITS, FILTERS * len(SIZES)
    if len(set(y.tolist())) < 2:
        empty = np.zeros((rows + 1, len(_COLUMNS) * FILTERS), np.float32)
        return Model(empty, empty, np.zeros(nf), np.zeros(nf), 0.0, np.ones(len(GROUPS)), np.zeros(len(GROUPS)), trained=False)
    emb = rng.normal(0, 0.02, (2, rows + 1, WIDTH)).astype(np.float32)
    emb[:, rows] = 0
    conv = rng.normal(0, 0.1, (len(_COLUMNS), WIDTH, FILTERS)).astype(np.float32)
    bias, out, shift = np.zeros(nf, np.float32), rng.normal(0, 0.05, nf).astype(np.float32), np.zeros(1, np.float32)
    memory = [None, *(np.full_like(p, 1e-4) for p in (conv, bias, out, shift))]
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 4], order[len(y) // 4 :]
    if len(set(y[held].tolist())) < 2 or len(set(y[own].tolist())) < 2:
        held = own = order
    weight = np.where(y > 0, 0.5 / max(1e-9, y[own].mean()), 0.5 / max(1e-9, 1 - y[own].mean())).astype(np.float32)
    rate, batch = 0.02, 16
    for t, evidence in enumerate(word_evidence([texts[i] for i in own], y[own])):
        emb[t, :rows, 0] += evidence / 2
    conv[[c for c, (_, j) in enumerate(_COLUMNS) if j == 0], 0, : FILTERS // 2] = 1.0
    out.reshape(len(SIZES), FILTERS)[:, : FILTERS // 2] = 0.3

    def forward(ids: np.ndarray):
        first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in ids])))
        a, b, begins = padded(np.concatenate([texts[i] for i in ids]) if first[-1] else np.zeros(0, np.uint64), first)
        e = emb[0][a] + emb[1][b]
        hidden, wins = [], []
        ends = np.append(begins[1:], len(a))
        for k, size in enumerate(SIZES):
            cols = [c for c, (kk, _) in enumerate(_COLUMNS) if kk == k]
            r = e @ conv[cols[0]]
            for j in range(1, size):
                r[: len(a) - j] += e[j:] @ conv[cols[j]]
            win = np.stack([s + r[s:t].argmax(axis=0) for s, t in zip(begins, ends)])
            hidden.append(np.take_along_axis(r, win, axis=0))
            wins.append(win)
        m = np.concatenate(hidden, axis=1) + bias
        return a, b, e, wins, m

    def update(p, mem, g):
        mem += g * g
        p -= rate * g / np.sqrt(mem)

    for _ in range(passes):
        for at in range(0, len(own), batch):
            ids = own[at : at + batch]
            a, b, e, wins, m = forward(ids)
            h = np.maximum(m, 0)
            z = h @ out + shift[0]
            dz = (sigmoid(z) - y[ids]) * weight[ids] / len(ids)
            dm = (dz[:, None] * out) * (m > 0)
            update(out, memory[3], h.T @ dz + 1e-4 * out)
            update(shift, memory[4], np.array([dz.sum()], np.float32))
            update(bias, memory[2], dm.sum(axis=0))
            g_conv, touched, g_rows = np.zeros_like(conv), [], []
            for c, (k, j) in enumerate(_COLUMNS):
                d = dm[:, k * FILTERS : (k + 1) * FILTERS]
                pos = np.minimum(wins[k] + j, len(a) - 1)
                g_conv[c] = np.einsum("df,dfw->wf", d, e[pos])
                touched.append(pos.ravel())
                g_rows.append((d[:, :, None] * conv[c].T[None]).reshape(-1, WIDTH))
            update(conv, memory[1], g_conv + 1e-4 * conv)
            pos, g = np.concatenate(touched), np.concatenate(g_rows)
            for t, idx in enumerate((a[pos], b[pos])):
                u, inv = np.unique(idx, return_inverse=True)
                gu = np.zeros((len(u), WIDTH), np.float32)
                np.add.at(gu, inv, g)
                gu[u == rows] = 0
                emb[t][u] -= EMBEDDING_RATE * gu
        own = rng.permutation(own)

    flat = [(emb[t] @ conv.transpose(1, 0, 2).reshape(WIDTH, -1)).astype(np.float32) for t in (0, 1)]
    model = Model(flat[0], flat[1], bias, out, float(shift[0]), np.ones(len(GROUPS)), np.zeros(len(GROUPS)))
    z = np.concatenate([np.maximum(forward(held[i : i + 64])[4], 0) @ out + shift[0] for i in range(0, len(held), 64)])
    slope, _ = platt(z, np.where(y[held] > 0, 1, -1))
    for g in range(len(GROUPS)):
        mine = group[held] == g
        if (y[held][mine] > 0).sum() < 5 or (y[held][mine] == 0).sum() < 5:
            mine = np.ones(len(held), dtype=bool)
        model.thresholds[g] = best_threshold(z[mine], y[held][mine])
        model.slopes[g] = max(slope, 1e-3)
    return model


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cut with the best balanced accuracy."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    below_neg = np.concatenate(([0], np.cumsum(y == 0))) / max(1, (y == 0).sum())
    above_pos = 1 - np.concatenate(([0], np.cumsum(y > 0))) / max(1, (y > 0).sum())
    gain = below_neg + above_pos
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    k = int(best[len(best) // 2])
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    return float(edges[k])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", label: str = "toxic", key: str = "doc_id", where: Column | None = None) -> Model:
    """Fits the network on at most about ``rows`` labelled documents, chosen by hash of their id; ``where`` restricts the labels."""
    known = agreed_labels(labels if where is None else labels.where(where), key, label)
    # at most about `rows` rows of two numbers: a proven bound
    sample = F.broadcast(bounded_sample(known, "__label", "__id", rows))
    joined = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")

    def run(batches):
        for batch in batches:
            out = []
            for r in TextBatch(batch.column(0)).runs():
                hashes, first = word_hashes(r)
                out += [hashes[i:j].tobytes() if j - i <= SAMPLE_WORDS else None for i, j in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["label", "hashes"])

    got = map_batches(one_text(joined).select("__text", "__label"), run, "label int, hashes binary").where("hashes is not null").orderBy("label", "hashes").limit(2 * rows).collect()
    texts = [np.frombuffer(r[1], np.uint64) for r in got]
    group = np.array([groups(t, np.array([0, len(t)]))[0] for t in texts], dtype=np.int64)
    return fit(texts, np.array([r[0] for r in got]), group)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (0/1); same-named columns are replaced. Only the text is read."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in {"score", "predicted"}]
    schema = T.StructType(kept + new)
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.scores(r) for r in TextBatch(batch.column(batch.num_columns - 1)).runs(1 << 20)]
            s = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return map_batches(frame, run, schema)
