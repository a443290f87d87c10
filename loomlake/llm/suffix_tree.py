"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and one end, each a
symbol; all words that training has not seen are one further symbol, unknown, so
the outcomes are those of the base score.

* Without context a known word has (count / tokens) of what unknown leaves, and
  unknown has what the words seen once suggest (Good and Turing).
* Contexts are the one to DEPTH symbols before a token; the place before a text
  counts as one symbol.  A context stays in the tree if its next symbols diverge
  from its suffix's: the log ratio of their probability under a distribution of
  the context's own (Dirichlet, STRENGTH tokens of the suffix's distribution)
  and under the suffix's must reach GAIN nats.  Where a context tells nothing,
  a ratio of e**GAIN comes by chance in at most one of e**GAIN contexts, however
  many symbols follow it: the test pays for its own degrees of freedom.
* A retained context's distribution is smoothed by its suffix's:
  P(s) = (count + (STRENGTH + singles) * shorter) / (tokens + STRENGTH), where a
  symbol that follows the context once counts as single and not for itself.
* The longest retained suffix of the symbols before a token is its state.

Nothing else prunes: neither share, nor rank, nor number of contexts.  What is kept
for some texts is kept at any size, and the tree grows with the corpus.

The work: texts become blocks of a few MB, stored once.  A block holds its distinct
words and each token's number among them.  Then blocks ask, step by step, for the
corpus counts of their distinct words and of their sequences of 2, 3 and 4 symbols,
and, a step behind, which contexts of 1, 2 and 3 symbols stay.  Each question is summed by hash range over all
blocks and answered in the order asked.  A sequence is asked for only if both its
first and its last part are found twice; the rest cannot be.  A block asks once for
what it holds many times, so no key meets more rows than there are blocks.  Tables
and shuffles of one step are removed when the next has been stored, and all are
removed at the end: only the scores remain in the shared folder.

Words and sequences are compared by 64-bit hash: two of n distinct ones are taken
for one with a probability of about n**2 / 2**65.

Null and empty texts are the end alone.  With no training row counts are 0 and
unknown has probability 1.  A null in ``train`` means that the row is not learned
from.  Rows with null or repeated keys are texts like others; other columns are
not read.  A text longer than a block is a block of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import FOLD, Run, Scratch, TextBatch, map_batches, mix, stored

DEPTH = 3
GAIN, STRENGTH = 3.0, 4.0
#: Training tokens that a sequence must have to count for itself.
LEAST = 2
#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20
#: Stand for the end of a text and the place before it among hashes.
END, START = np.uint64(0), np.uint64(2)


def tokens_of(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a run's tokens (words, then an end, document by document), and each document's number of tokens."""
    data = FOLD[run.data]
    starts, stops, first = run.words(data)
    hashes = run.word_hashes(starts, stops, data)
    hashes[hashes == END] = np.uint64(1)
    lengths = np.diff(first)
    out = np.full(len(hashes) + len(run), END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(run)), lengths)] = hashes
    return out, lengths + 1


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes as the largest needs, the lowest bytes of all first, compressed."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in range(1, 9) if top < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<BQ", width, len(values)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", blob)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0 (Stirling's series at x + 8)."""
    x = np.asarray(x, dtype=np.float64)
    y, low = x + 8, x.copy()
    for i in range(1, 8):
        low *= x + i
    low = np.log(low)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def evidence(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a symbol seen c times after a context adds to the context's log ratio, with q its probability after the suffix."""
    return log_gamma(STRENGTH * q + c) - log_gamma(STRENGTH * q) - c * np.log(q)


def gain_of(n: np.ndarray, m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log ratio of contexts with n tokens, m of them symbols seen LEAST times or more with evidence t; the others are single."""
    return t + (n - m) * np.log(STRENGTH) + log_gamma(np.float64(STRENGTH)) - log_gamma(STRENGTH + n)


# ---------------------------------------------------------------- blocks


def block_type(key: T.DataType) -> T.StructType:
    names = [("block", T.LongType()), ("keys", T.ArrayType(key)), ("lengths", T.BinaryType()), ("learn", T.BinaryType()), ("ids", T.BinaryType()), ("words", T.BinaryType()), ("rank", T.BinaryType()), ("own", T.BinaryType()), ("n_learn", T.LongType())]
    return T.StructType([T.StructField(n, k) for n, k in names])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of about BLOCK_BYTES of a partition's texts (key, train, text)."""
    number = TaskContext.get().partitionId() << 24
    keys, learn, hashes, lengths, size = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        flat, n, use = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(learn)
        words, ids = np.unique(flat, return_inverse=True)
        own = np.bincount(ids, np.repeat(use, n), len(words)).astype(np.int64)
        rank = np.empty(len(words), dtype=np.int64)  # frequent words have small numbers, which compress
        rank[np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")] = np.arange(len(words))
        held = pa.concat_arrays(keys)
        row = [packed(n), packed(use), packed(rank[ids]), packed(_gaps(words)), packed(rank), packed(own)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays([0, len(held)], held), *(pa.array([b], pa.binary()) for b in row), pa.array([int(use.sum())], pa.int64())],
            names=["block", "keys", "lengths", "learn", "ids", "words", "rank", "own", "n_learn"],
        )

    for batch in batches:
        texts = TextBatch(batch.column(2))
        use = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for run in texts.runs():
            h, n = tokens_of(run)
            keys.append(batch.column(0).slice(run.first, len(run)))
            learn.append(use[run.first : run.first + len(run)])
            hashes.append(h)
            lengths.append(n)
            size += len(run.data)
            if size >= BLOCK_BYTES:
                yield block()
                number += 1
                keys, learn, hashes, lengths, size = [], [], [], [], 0
    if keys:
        yield block()


def _gaps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


# ---------------------------------------------------------------- questions

ASK = "block bigint, level int, part int, keys binary, n binary, m binary, t binary"
TOLD = "block bigint, level int, part int, told binary, total bigint, known bigint, once bigint"


def _questions(block: int, level: int, parts: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray | None = None, t: np.ndarray | None = None) -> pa.Table:
    """One row for each range of hashes in which the block has some of its (ordered) keys."""
    part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else []
    rows = [(a, b) for a, b in zip(cuts, cuts[1:])]
    columns = [
        pa.array([block] * len(rows), pa.int64()),
        pa.array([level] * len(rows), pa.int32()),
        pa.array([int(part[a]) for a, _ in rows], pa.int32()),
        pa.array([packed(_gaps(keys[a:b])) for a, b in rows], pa.binary()),
        pa.array([packed(n[a:b]) for a, b in rows], pa.binary()),
        pa.array([None if m is None else packed(m[a:b]) for a, b in rows], pa.binary()),
        pa.array([None if t is None else pa.compress(t[a:b].astype(np.float32).tobytes(), "zstd", asbytes=True) for a, b in rows], pa.binary()),
    ]
    return pa.table(columns, names=["block", "level", "part", "keys", "n", "m", "t"])


def _answer(asked: pa.Table) -> pa.Table:
    """Sums a range of one level's hashes over all blocks and answers each block in the order of its keys.

    Words (level 0) get counts; sequences (up to DEPTH) counts of LEAST or more, else 0;
    contexts (beyond) the tokens in repeated symbols if the context stays, else 0.
    """
    asked, level = asked.sort_by("block"), asked.column("level")[0].as_py()
    keys = [np.cumsum(unpacked(b), dtype=np.uint64) for b in asked.column("keys").to_pylist()]
    own, where = np.unique(np.concatenate(keys), return_inverse=True)
    n = [unpacked(b) for b in asked.column("n").to_pylist()]
    if level <= DEPTH:
        sums = np.bincount(where, np.concatenate(n), len(own)).astype(np.int64)
        told = sums if level == 0 else np.where(sums >= LEAST, sums, 0)
    else:
        sums = np.zeros(len(own), dtype=np.int64)
        sums[where] = np.concatenate(n)
        m = np.bincount(where, np.concatenate([unpacked(b) for b in asked.column("m").to_pylist()]), len(own))
        t = np.bincount(where, np.concatenate([np.frombuffer(pa.decompress(b, 4 * len(k), "zstd", asbytes=True), np.float32) for b, k in zip(asked.column("t").to_pylist(), keys)]), len(own))
        told = np.where((m > 0) & (gain_of(sums.astype(np.float64), m, t) >= GAIN), m, 0).astype(np.int64)
    answers = np.split(told[where], np.cumsum([len(k) for k in keys])[:-1])
    rows = asked.num_rows
    first = [[int(v)] + [0] * (rows - 1) for v in (told.sum(), (told > 0).sum(), (told == 1).sum())]
    columns = [asked.column("block"), asked.column("level"), asked.column("part"), pa.array([packed(a) for a in answers], pa.binary()), *(pa.array(v, pa.int64()) for v in first)]
    return pa.table(columns, names=["block", "level", "part", "told", "total", "known", "once"])


class Corpus:
    """Totals over all training texts: tokens, distinct ones, those seen once, texts."""

    def __init__(self, tokens: int, distinct: int, once: int, texts: int):
        self.tokens, self.distinct, self.once, self.texts = tokens, distinct, once, texts

    def unigram(self, c: np.ndarray) -> np.ndarray:
        unknown = (self.once + 1) / (self.tokens + self.once + 1)
        return np.where(c > 0, (1 - unknown) * c / max(1, self.tokens), unknown)


class Block:
    """A block's tokens and what it has been told so far."""

    def __init__(self, row: dict, told: pa.Table, corpus: Corpus):
        self.number, self.corpus = row["block"], corpus
        self.lengths, self.learn = unpacked(row["lengths"]).astype(np.int64), unpacked(row["learn"]) > 0
        words, rank = np.cumsum(unpacked(row["words"]), dtype=np.uint64), unpacked(row["rank"])
        ids = np.argsort(rank, kind="stable")[unpacked(row["ids"])]
        begins = np.cumsum(self.lengths) - self.lengths
        self.begins = begins
        self.place = np.arange(len(ids)) - np.repeat(begins, self.lengths)
        self.use = np.repeat(self.learn, self.lengths)
        self.word = words[ids]
        told = told.select(["level", "part", "told"]).sort_by([("level", "ascending"), ("part", "ascending")])
        self.told: dict[int, np.ndarray] = {}
        for level in range(2 * DEPTH + 1):
            own = [unpacked(b) for b, k in zip(told.column("told").to_pylist(), told.column("level").to_pylist()) if k == level]
            self.told[level] = np.concatenate(own) if own else np.zeros(0, np.int64)
        #: For each level, by token: sequence's hash and count, and the count of the context before its last symbol.
        self.hash, self.count, self.before = [mix(self.word)], [self.told[0][ids].astype(np.int64)], [np.zeros(0, np.int64)]

    def shifted(self, values: np.ndarray, start) -> np.ndarray:
        """By token the value of the token before it; ``start`` where a text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.begins] = start
        return out

    def climb(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens whose sequence of level + 1 symbols may be found twice, and those sequences' hashes.

        A sequence reaches no further back than one place before its text.
        """
        before = self.shifted(self.count[level - 1], self.corpus.texts if level == 1 else 0)
        before[self.place < level - 1] = 0
        self.before.append(before)
        at = np.flatnonzero((self.count[level - 1] >= LEAST) & (before >= LEAST))
        context = np.where(self.place[at] > 0, self.hash[level - 1][at - 1], START)
        with np.errstate(over="ignore"):
            hashes = mix(context * np.uint64(3) + self.word[at] + np.uint64(level))
        self.hash.append(np.zeros(len(self.word), dtype=np.uint64))
        self.hash[level][at] = hashes
        return at, hashes

    def rise(self, levels: int) -> None:
        """Counts of all sequences of up to levels + 1 symbols, as told."""
        for level in range(1, levels + 1):
            at, hashes = self.climb(level)
            own, where = np.unique(hashes, return_inverse=True)
            count = np.zeros(len(self.word), dtype=np.int64)
            count[at] = self.told[level][where]
            self.count.append(count)

    def sequences(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct sequences of level + 1 symbols and their tokens in the block's training texts; shorter ones have been told."""
        at, hashes = self.climb(level)
        own, where = np.unique(hashes, return_inverse=True)
        return own, np.bincount(where, self.use[at], len(own)).astype(np.int64)

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ordered hashes of the block's contexts of a length, the tokens that have one, and its number among them."""
        tokens = np.flatnonzero(self.before[length] >= LEAST)
        own, number = np.unique(np.where(self.place[tokens] > 0, self.hash[length - 1][tokens - 1], START), return_inverse=True)
        return own, tokens, number

    def divergence(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's contexts of a length with their tokens in all texts, and the block's part of m and t (see ``gain_of``)."""
        own, tokens, number = self.contexts(length)
        n = np.zeros(len(own), np.int64)
        n[number] = self.before[length][tokens]
        mine = self.use[tokens] & (self.count[length][tokens] >= LEAST)
        tokens, number = tokens[mine], number[mine]
        c = self.count[length][tokens].astype(np.float64)
        q = self.count[length - 1][tokens] / (self.before[length - 1][tokens] if length > 1 else max(1, self.corpus.tokens))
        # each of a sequence's tokens brings its share, so that blocks add up to the whole
        return own, n, np.bincount(number, minlength=len(own)), np.bincount(number, evidence(c, q) / c, len(own))

    def ask(self, step: int, parts: int) -> list[pa.Table]:
        self.rise(step - 1)
        out = [_questions(self.number, DEPTH + step - 1, parts, *self.divergence(step - 1))] if step > 1 else []
        return [*out, _questions(self.number, step, parts, *self.sequences(step))] if step <= DEPTH else out

    def probabilities(self) -> np.ndarray:
        """Of every token given its state."""
        self.rise(DEPTH)
        p = self.corpus.unigram(self.count[0])
        for length in range(1, DEPTH + 1):
            _, tokens, number = self.contexts(length)
            m = self.told[DEPTH + length][number].astype(np.float64)
            kept = m > 0
            tokens, m = tokens[kept], m[kept]
            n = self.before[length][tokens]
            p[tokens] = (self.count[length][tokens] + (STRENGTH + n - m) * p[tokens]) / (n + STRENGTH)
        return p


# ---------------------------------------------------------------- jobs


def _of(f, *fixed):
    """f with its first arguments fixed, for two tables of one block."""
    return lambda blocks, told: f(*fixed, blocks, told)


def _ask_words(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from _questions(row["block"], 0, parts, np.cumsum(unpacked(row["words"]), dtype=np.uint64), unpacked(row["own"])).to_batches()


def _ask(step: int, parts: int, corpus: Corpus, blocks: pa.Table, told: pa.Table) -> pa.Table:
    return pa.concat_tables(t for row in blocks.to_pylist() for t in Block(row, told, corpus).ask(step, parts))


def _score(corpus: Corpus, schema: T.StructType, blocks: pa.Table, told: pa.Table) -> pa.Table:
    out = []
    for row in blocks.drop_columns(["keys"]).to_pylist():
        block = Block(row, told, corpus)
        c = block.count[0]
        base = np.log10((c + 0.5) / (corpus.tokens + 0.5 * (corpus.distinct + 1)))
        score = np.log10(block.probabilities())
        known, base, score = (np.add.reduceat(v, block.begins) for v in ((c > 0).astype(np.int64), base, score))
        out.append((block.lengths, known, np.full(len(known), corpus.tokens, np.int64), base, score))
    columns = [pa.array(np.concatenate(v)) for v in zip(*out)]
    return pa.table([blocks.column("keys").combine_chunks().flatten(), *columns], names=schema.names)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows the model learns from.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    given = docs.select(F.col(key).alias("__key"), F.coalesce(train, F.lit(False)).alias("__train"), F.col(text).cast("string").alias("__text"))
    with Scratch(spark, "lm") as scratch:
        blocks = scratch.store(map_batches(given, _blocks, block_type(kind)), "blocks")
        n, texts = blocks.agg(F.count("*"), F.coalesce(F.sum("n_learn"), F.lit(0))).first()
        parts = max(1, n // 2)
        scratch.partitions(parts)
        corpus, told = Corpus(0, 0, 0, texts), None
        lean = blocks.drop("keys", "own", "n_learn")
        for step in range(DEPTH + 2):
            if told is None:
                asked = map_batches(blocks.select("block", "words", "own"), partial(_ask_words, parts), ASK)
            else:
                asked = lean.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_of(_ask, step, parts, corpus), ASK)
            answers = scratch.store(asked.groupBy("level", "part").applyInArrow(lambda asked: _answer(asked), TOLD), f"told-{step}")
            if told is None:
                total = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "known", "once"))).first()
                corpus = Corpus(*total, texts)
            told = answers if told is None else told.unionByName(answers)
        names = (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
        schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, k) for n, k in names)])
        scored = blocks.drop("own", "n_learn").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_of(_score, corpus, schema), schema)
        return stored(scored, "lm-scores")
