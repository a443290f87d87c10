"""Target-distribution importance resampling with overlap chunking for skewed long texts.

Features are all runs of one to three consecutive words, hashed into buckets.
Each bucket has a gain, the scaled logarithm of its share in the target texts
over its share in the documents (both smoothed); a document's weight is the sum
of the gains of its features, and the documents with the highest weight plus
Gumbel noise are drawn.

Long texts are the skew of the two passes over features.  They are cut at word
boundaries into chunks, each with the next two words carried along; a chunk owns
the runs that start in its own words, so every run is counted once.  Chunks are
spread over all tasks, and counts and weights are summed by document.  Texts of
at most ``CHUNK_BYTES`` are a chunk by themselves and stay in their scan, so
ordinary texts are never shuffled.

* Pass one sums buckets in each task and then over tasks: at most BUCKETS rows a
  task.  The table of gains has a fixed size (BUCKETS numbers).
* Pass two gives a weight for each chunk; only chunks of long texts are grouped.
* Ranks over all drawn documents come from a range partitioning of (score, id)
  and the partitions' sizes, not from one ordered window.

Buckets are CRC-32 values of whole features: words by table look-up, all words
of a run of texts at once; runs of two and three by the rule for the CRC of a
concatenation.

Cases: a null or empty text, or one without words, has no features and weight 0.
Words may be of any length.  Rows are documents: repeated rows and ids are
counted, weighed and drawn row by row.  A null id is hashed as the empty string
and comes last among ties.  Empty tables of documents give no rows; an empty
target gives every bucket the gain of absence.  Input columns other than id and
text are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import FOLD, Scratch, TextBatch, map_batches, stored

#: Buckets, words in the longest run, least words of a drawn document, hundredths drawn, seed.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"
#: Bytes of the own words of a chunk, up to the end of the word at that place.
CHUNK_BYTES = 1 << 16

#: Bytes of words after lower-casing: digits, letters and all beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# ------------------------------------------------------------ chunks


def cut(text: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """The chunks of a text with the number of words that each owns; ``size`` bounds the own words' bytes but for the last word.

    Cuts fall between two words; the words carried over follow the own ones.
    """
    data = np.frombuffer(text, np.uint8)
    starts, stops, _ = _words(data, np.array([0, len(data)]))
    if not len(starts):
        yield text, 0
        return
    of = starts // size  # a chunk's own words start in its stretch of bytes
    first = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(starts)]))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        last = min(b + LONGEST - 1, len(starts)) - 1
        yield text[starts[a] : stops[last]], b - a


def chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk, piece, own): the chunks of texts, spread over all tasks."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = TextBatch(batch.column(1))
            for i in range(len(texts)):
                pieces = list(cut(texts.text(i), size))
                keys = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(pieces))
                columns = [keys, pa.array(range(len(pieces)), pa.int32()), pa.array([p for p, _ in pieces], pa.binary()), pa.array([n for _, n in pieces], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk", "piece", "own"])

    out = map_batches(docs.select(key, text), run, f"`{key}` {kind}, chunk int, piece binary, own bigint")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, key, "chunk")


# ------------------------------------------------------------ features


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n+1 entries)."""
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] |= inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


#: What each byte of a register of zeros leaves behind.
_TABLE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
#: For each length the four tables that carry a CRC over that many bytes.
_shifts: dict[int, np.ndarray] = {}
#: Words of up to so many bytes are looked up byte by byte, all at once; longer ones each by themselves.
TOGETHER = 48


def _zeros(crc: int, n: int) -> int:
    """The effect of n further bytes on the part of a CRC that depends on what stands before them."""
    return zlib.crc32(bytes(n), crc) ^ zlib.crc32(bytes(n), 0)


def _carried(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts carried over so many further bytes; xor with the CRC of these bytes gives that of both."""
    out = np.empty_like(crc)
    order = np.argsort(lengths, kind="stable")
    bounds = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        own = order[a:b]
        n = int(lengths[own[0]])
        if n > 4 * TOGETHER:  # each by itself: such words are rare
            out[own] = [_zeros(int(c), n) for c in crc[own]]
            continue
        if n not in _shifts:
            bits = [_zeros(1 << k, n) for k in range(32)]
            tables = np.zeros((4, 256), dtype=np.uint32)
            for part in range(4):
                for bit in range(8):
                    tables[part, (np.arange(256) >> bit) & 1 == 1] ^= np.uint32(bits[8 * part + bit])
            _shifts[n] = tables
        t, x = _shifts[n], crc[own]
        out[own] = t[0, x & 255] ^ t[1, (x >> 8) & 255] ^ t[2, (x >> 16) & 255] ^ t[3, x >> 24]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    begin, length = starts[order], lengths[order]
    state = out[order]
    for k in range(min(TOGETHER, int(length[-1])) if len(length) else 0):
        a = int(np.searchsorted(length, k, side="right"))  # the words that have a byte k
        x = state[a:]
        state[a:] = _TABLE[(x ^ data[begin[a:] + k]) & 255] ^ (x >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(length, TOGETHER, side="right")), len(length)):
        state[i] = zlib.crc32(data[begin[i] : begin[i] + length[i]].tobytes())
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of words and the text that it belongs to; ``own`` bounds the starting words of a text (-1: all)."""
    data = FOLD[data]
    starts, stops, first = _words(data, offsets)
    counts = np.diff(first)
    owned = np.where(own < 0, counts, own)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - first[text]
    left = counts[text] - place  # words from here to the end of the text
    owner = place < owned[text]
    lengths = stops - starts
    single = word_crcs(data, starts, lengths)
    space = np.uint32(zlib.crc32(b" "))
    # the CRC of a space and the word: the space's carried over the word
    spaced = _carried(np.full(len(single), space, dtype=np.uint32), lengths) ^ single
    at = np.flatnonzero(owner)
    out, of = [single[at]], [text[at]]
    crc = single
    for k in range(1, LONGEST):
        whole = np.flatnonzero(left > k)
        longer = np.zeros_like(crc)
        longer[whole] = _carried(crc[whole], lengths[whole + k] + 1) ^ spaced[whole + k]
        crc = longer
        at = np.flatnonzero(owner & (left > k))
        out.append(crc[at])
        of.append(text[at])
    return (np.concatenate(out) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(of)


def _over(frame: DataFrame, text: str, own: str | None, schema: str, f: Callable[[], Callable]) -> DataFrame:
    """Runs a function of (buckets, texts, words owned, batch columns) over runs of texts; it yields Arrow columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f()(_measured(batches, text, own))

    return map_batches(frame, run, schema)


def _measured(batches: Iterator[pa.RecordBatch], text: str, own: str | None):
    for batch in batches:
        owned = np.full(batch.num_rows, -1) if own is None else batch.column(own).to_numpy(zero_copy_only=False)
        for run in TextBatch(batch.column(text)).runs():
            rows = slice(run.first, run.first + len(run))
            counts = np.diff(_words(run.data, run.offsets)[2])
            buckets, of = features(run.data, run.offsets, owned[rows])
            yield batch.slice(run.first, len(run)), np.where(owned[rows] < 0, counts, owned[rows]), buckets, of


def bucket_counts(frame: DataFrame, text: str = "text", own: str | None = None) -> DataFrame:
    """(bucket, n): at most BUCKETS rows from each task, to be summed."""

    def count():
        def rows(measured) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BUCKETS, dtype=np.int64)
            for _, _, buckets, _ in measured:
                total += np.bincount(buckets, minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

        return rows

    return _over(frame.select(text, *([own] if own else [])), text, own, "bucket bigint, n bigint", count)


def weights(frame: DataFrame, gains: np.ndarray, key: str, text: str = "text", own: str | None = None) -> DataFrame:
    """(key, n_words, n_features, weight) of each row."""
    kind = frame.schema[key].dataType.simpleString()

    def weigh():
        def rows(measured) -> Iterator[pa.RecordBatch]:
            for batch, words, buckets, of in measured:
                n = np.bincount(of, minlength=len(words))
                sums = np.bincount(of, weights=gains[buckets], minlength=len(words)).astype(np.int64)  # whole numbers, exact below 2**53
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums)], names=[key, "n_words", "n_features", "weight"])

        return rows

    return _over(frame.select(key, text, *([own] if own else [])), text, own, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint", weigh)


# ------------------------------------------------------------ gains, scores, ranks


def _totals(counts: DataFrame) -> np.ndarray:
    """Counts by bucket as an array of fixed size."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (float(source.sum()) + BUCKETS)) / ((s + 1) * (float(target.sum()) + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(1000 * Gumbel noise) of a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, score: str, key: str, scratch: Scratch) -> DataFrame:
    """Adds ``place`` (0, 1, ...) by descending score, then ascending key with nulls last.

    Rows are sorted in ranges; a row's place is its number in its range plus the sizes of the ranges before,
    of which there are as many as shuffle partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(score).desc(), F.col(key).asc_nulls_last(), F.col("__tie")]
    rows = scratch.store(rows.withColumn("__tie", F.monotonically_increasing_id()), "tied")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = scratch.store(rows.drop("__tie"), "ranges")
    part, number = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for p, size in sorted(map(tuple, rows.groupBy(part.alias("p")).count().collect())):  # a row for each range
        offsets.append((p, before))
        before += size
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part long, __before long"))
    rows = rows.withColumn("__part", part).join(offsets, "__part")
    return rows.withColumn("place", number + F.col("__before")).drop("__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, size: int = CHUNK_BYTES) -> DataFrame:
    """(key, n_features, weight, score, rank) of each document; ``rank`` is null where it is not drawn."""
    spark = docs.sparkSession
    with Scratch(spark, "resample") as scratch:
        length = F.octet_length(F.coalesce(text, F.lit("")))
        rows = docs.select(key, text)
        short = rows.where(length <= size)
        # rows are documents: a number made in the scan and stored with the chunks names each long one
        long = rows.where(length > size).withColumn("__row", F.monotonically_increasing_id())
        long = long.withColumn("__doc", F.struct("__row", F.col(key).alias("id")))
        pieces = scratch.store(chunks(long, "__doc", text, size), "chunks")
        source = _totals(bucket_counts(short, text).unionByName(bucket_counts(pieces, "piece", "own")))
        aims = target.where(length <= size)
        far = chunks(target.where(length > size).select(F.monotonically_increasing_id().alias("__doc"), text), "__doc", text, size)
        gains = bucket_gains(source, _totals(bucket_counts(aims, text).unionByName(bucket_counts(far, "piece", "own"))))
        whole = weights(short, gains, key, text)
        sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
        parts = weights(pieces, gains, "__doc", "piece", "own").groupBy("__doc").agg(*sums)
        measured = whole.unionByName(parts.select(F.col("__doc.id").alias(key), "n_words", "n_features", "weight"))
        measured = scratch.store(measured.withColumn("score", F.col("weight") + noise(F.col(key), seed)), "measured")
        enough = F.col("n_words") >= least_words
        drawn = measured.where(enough).count() * percent // 100
        places = ranked(measured.where(enough), "score", key, scratch)
        places = places.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
        out = places.select(key, "n_features", "weight", "score", "rank")
        rest = measured.where(~enough).select(key, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return stored(out.unionByName(rest), "resampled")
