"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

The test items' word n-grams that are rare by chance are the seeds: an n-gram
counts as rare if, with the corpus's word frequencies, fewer than RARE chance
occurrences of it are expected in a document of mean length.  That keeps the
seeds of a passage that many documents copy, which a cut on its own document
frequency would lose.  Word frequencies are counted over the whole corpus.

Every passage of a document around a seed shared with an item is aligned with
the item by Smith-Waterman on words (match +2, mismatch -1, gap -1).  The score
divided by that of a full copy is the similarity; documents with a similarity of
LEAK_AT or more hold a leak.  Words are runs of letters, digits and non-ASCII
bytes, with A-Z lower-cased, so punctuation and case do not matter.

Items are taken in blocks of at most BLOCK_BYTES of text.  The corpus is read twice
however many blocks there are: once for word counts, once for seeds and alignments.
Each block is a broadcast of its own, bounded by BLOCK_BYTES, and a task holds one
block at a time.  Documents are never shuffled.

Null and empty texts hold no leaks.  An item whose n-grams are all common is seeded
by the COMMON_SEEDS least common of them and its whole word sequence; one of fewer
than SEED_WORDS words by its word sequence.  Items without words are ignored.  Items
with a null id are reported with a null id, repeated items each.  Repeated documents
are reported each, very long ones whole.  ``leaks`` replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import Run, TextBatch, map_batches, mix
from loomlake.llm.toxicity import _MAP as WORD_BYTES

SEED_WORDS = 3
#: Expected chance occurrences in a document of mean length below which an n-gram is a seed.
RARE = 1e-4
#: Seeds of an item that has no rare n-gram.
COMMON_SEEDS = 4
LEAK_AT = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 4 << 20
#: Bytes of documents that meet a block each time it is loaded, where there are several.
GATHER_BYTES = 32 << 20

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
]))


def hashed_words(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and each document's first word (n+1 entries)."""
    data = WORD_BYTES[run.data]
    starts, stops, first = run.words(data)
    return run.word_hashes(starts, stops, data), first


def gram_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """A key for each window of n words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    key = hashes[: len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            key = mix(key * np.uint64(3) + hashes[j : len(hashes) - n + 1 + j])
    return key


class Lookup:
    """Membership of 64-bit keys in a sorted set, with a bitmap in front of the search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        self.bitmap[self.keys >> np.uint64(64 - self.BITS)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that are members, and their indices in the set."""
        at = np.flatnonzero(self.bitmap[keys >> np.uint64(64 - self.BITS)])
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[k] == keys[at]
        return at[hit], k[hit]


@dataclass
class Block:
    """Items of one block: their word hashes, and for each seed size the seeds with their places in items."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]  # size: lookup, first place of each seed, item, offset


def item_words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for run in TextBatch(pa.array(texts, pa.string())).runs():
        hashes, first = hashed_words(run)
        out += [hashes[a:b] for a, b in zip(first, first[1:])]
    return out


def build(ids: list[int | None], words: list[np.ndarray], chance: dict[int, float], mean_words: float) -> Block:
    """Picks the rare n-grams of a block's items."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for item, own in enumerate(words):
        if not len(own):
            continue
        p = np.array([chance.get(int(h), 0.0) for h in own])
        rare = False
        if len(own) >= SEED_WORDS:
            expected = mean_words * np.prod([p[j : len(own) - SEED_WORDS + 1 + j] for j in range(SEED_WORDS)], axis=0)
            offsets = np.flatnonzero(expected < RARE)
            rare = bool(len(offsets))
            keys = gram_keys(own, SEED_WORDS)
            for offset in offsets if rare else np.argsort(expected, kind="stable")[:COMMON_SEEDS]:
                found.setdefault(SEED_WORDS, []).append((int(keys[offset]), item, int(offset)))
        if not rare:
            found.setdefault(len(own), []).append((int(gram_keys(own, len(own))[0]), item, 0))
    seeds = {}
    for size, rows in found.items():
        rows.sort()
        keys = np.array([r[0] for r in rows], dtype=np.uint64)
        lookup = Lookup(keys)
        seeds[size] = (lookup, np.append(np.searchsorted(keys, lookup.keys), len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Block(ids, words, seeds)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of an item in a passage, and the passage's first and last aligned word.

    One row for each item word; gaps along the passage are resolved by a running maximum.
    """
    n = len(passage)
    ramp = np.arange(n + 1, dtype=np.int64) * -GAP
    score = np.zeros(n + 1, dtype=np.int64)
    begin = np.arange(n + 1, dtype=np.int64)
    best = (0, 0, 0)
    for w in item:
        diagonal = np.zeros(n + 1, dtype=np.int64)
        diagonal[1:] = score[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = score + GAP
        row = np.maximum(np.maximum(diagonal, up), 0)
        came = np.where(row == 0, np.arange(n + 1), begin)
        from_diagonal = (row == diagonal) & (row > 0)
        came[1:][from_diagonal[1:]] = begin[:-1][from_diagonal[1:]]
        lifted = row + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, begin = np.maximum(top - ramp, 0), np.where(top - ramp > row, came[source], came)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k - 1)
    return best


def leaks(run: Run, block: Block, leak_at: float) -> list[list[tuple[int | None, float, int, int]]]:
    """For each document of a run the items that it leaks, with similarity and the passage's first and last word."""
    hashes, first = hashed_words(run)
    out: list[list] = [[] for _ in range(len(run))]
    if not len(hashes):
        return out
    places: dict[tuple[int, int], list[int]] = {}
    for size, (lookup, begins, items, offsets) in block.seeds.items():
        at, seed = lookup.find(gram_keys(hashes, size))
        doc = np.searchsorted(first, at, side="right") - 1
        whole = at + size <= first[doc + 1]
        for p, k, d in zip(at[whole].tolist(), seed[whole].tolist(), doc[whole].tolist()):
            for r in range(begins[k], begins[k + 1]):
                places.setdefault((d, int(items[r])), []).append(p - int(offsets[r]))
    for (d, item), starts in places.items():
        words = block.words[item]
        slack = len(words) // 2 + 4
        starts.sort()
        lo, regions = None, []
        for s in starts:  # passages that overlap are aligned as one
            if lo is None or s - slack > hi:
                if lo is not None:
                    regions.append((lo, hi))
                lo = s - slack
            hi = s + len(words) + slack
        regions.append((lo, hi))
        best = (0, 0, 0)
        for a, b in regions:
            a, b = max(a, int(first[d])), min(b, int(first[d + 1]))
            found = smith_waterman(words, hashes[a:b])
            if found[0] > best[0]:
                best = (found[0], found[1] + a - int(first[d]), found[2] + a - int(first[d]))
        similarity = best[0] / (MATCH * len(words))
        if similarity >= leak_at:
            out[d].append((block.ids[item], similarity, best[1], best[2]))
    return out


def word_chances(docs: DataFrame, text: str, vocabularies: list[np.ndarray]) -> tuple[list[dict[int, float]], float]:
    """For each vocabulary the share of its words among the words of the whole corpus, and the mean number of words of a document."""
    spark = docs.sparkSession
    vocabularies = [np.unique(v) for v in vocabularies]
    shared = [spark.sparkContext.broadcast(v) for v in vocabularies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [Lookup(s.value) for s in shared]
        counts = [np.zeros(len(x.keys), dtype=np.int64) for x in lookups]
        sums = np.zeros(2, dtype=np.int64)
        for batch in batches:
            texts = TextBatch(batch.column(0))
            sums[1] += len(texts)
            for r in texts.runs():
                hashes, _ = hashed_words(r)
                sums[0] += len(hashes)
                for lookup, own in zip(lookups, counts):
                    _, k = lookup.find(hashes)
                    own += np.bincount(k, minlength=len(own))
        for block, own in enumerate([*counts, sums]):
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some), pa.array(own[some])], names=["block", "word", "n"])

    # one row for each word of the benchmark at most
    rows = map_batches(docs.select(text), run, "block bigint, word bigint, n bigint").groupBy("block", "word").agg(F.sum("n").alias("n")).collect()
    n = [np.zeros(len(v)) for v in vocabularies] + [np.zeros(2)]
    for r in rows:
        n[r["block"]][r["word"]] = r["n"]
    total, documents = max(1.0, n[-1][0]), max(1.0, n[-1][1])
    return [{int(k): c / total for k, c in zip(v, own)} for v, own in zip(vocabularies, n)], total / documents


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list[int | None], list[str]]]:
    """The items in blocks of at most BLOCK_BYTES of text (or one longer item)."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if texts and size + len(row[1]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
    if texts:
        yield ids, texts


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", leak_at: float = LEAK_AT, out: str = "leaks") -> DataFrame:
    """All columns of ``docs`` with ``leaks``: array<struct<item_id, similarity, first_word, last_word>>, empty for clean documents."""
    spark = docs.sparkSession
    parts = [(ids, item_words(texts)) for ids, texts in blocks(benchmark, item, item_text)]
    parts = [(ids, words) for ids, words in parts if sum(map(len, words))]
    if not parts:
        return docs.withColumn(out, F.array().cast(MATCHES))
    chances, mean_words = word_chances(docs, text, [np.concatenate(words) for _, words in parts])
    shared = [spark.sparkContext.broadcast(build(ids, words, own, mean_words)) for (ids, words), own in zip(parts, chances)]
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, MATCHES)])
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared[0].value if len(shared) == 1 else None
        for batch in batches if len(shared) == 1 else gathered(batches):
            texts = TextBatch(batch.column(batch.num_columns - 1))
            found: list[list] = [[] for _ in range(len(texts))]
            for handle in shared:
                block = only or handle.load_from_path(handle._path)  # not kept: one block at a time
                for r in texts.runs():
                    for i, rows in enumerate(leaks(r, block, leak_at), r.first):
                        found[i] += rows
            for rows in found:
                rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
            rows = [[{"item_id": i, "similarity": s, "first_word": x, "last_word": y} for i, s, x, y in f] for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(rows, kind)], names=schema.names)

    return map_batches(frame, run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, in batches of about ``most`` bytes: every batch loads all blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row for each document and item that it leaks: key, item_id, similarity, first_word, last_word."""
    marked = scan(docs, benchmark, **options)
    return marked.select(F.col(key), F.explode(options.get("out", "leaks")).alias("m")).select(key, "m.*")
