"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The merges are not run word by word.  A task takes the distinct words (matches
of the pre-tokenizer's pattern) of a block of texts, lays them out as one array
of symbols linked to their left and right neighbours, and builds an inverted
index from token pair to the positions at which the pair stands.  Pairs that
join to the same token share an entry.  The merges of the vocabulary are then
replayed over the whole block: the entry of the lowest rank is taken from a heap
of those that occur, all its positions are joined from left to right, and only
the pairs with the two neighbours that a join touches are entered anew.  Ranks
that do not occur cost nothing, and a block's work is the number of joins, not
words times ranks.

A join may open a pair of a lower rank than its own, which a word by itself
would join before its next pair of the present rank.  Such words are replayed
alone by the same code, one join at a time, so that the ids are always those of
the word-by-word definition.  A word that is a token as a whole is that token.

Large entries, which come first in a trained vocabulary, are joined with arrays,
small ones position by position.  Blocks are bounded in bytes, and words that a
worker has replayed are kept for its next blocks up to a bound.  There is no shuffle: what would travel in a join of
words with ids is every occurrence of every word.

Cases: null texts count as empty and have no ids.  Ids that are no token raise on
decoding; null ids decode to null bytes.  A word of any length is replayed in
O(n log n).  Rows are independent, so ties, repeated rows and null ids of
documents need nothing; an empty table gives an empty table.  Columns of the
input whose names are among the new ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlake.llm.bpe import Decoder
from loomlake.llm.common import TextBatch, map_batches

#: Bytes of texts in a block (one longer text is a block by itself).
BLOCK_BYTES = 4 << 20
#: A worker forgets the words that it has replayed before a block if they are more, or longer in sum, than this.
KEPT_WORDS, KEPT_CHARS = 400_000, 8_000_000
#: An entry of fewer positions is joined one by one; after so many such entries in a row all others are.
FEW, IN_A_ROW = 24, 32


class MergeReplay:
    """A byte-level vocabulary of ranks, with the token that each pair of tokens joins to."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {i: t for t, i in self.ids.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"{path} has no token for {len(missing)} of the 256 bytes")
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = max(self.tokens).bit_length()
        ids = self.ids
        self.joins: dict[int, int] = {}
        for token, i in ids.items():
            for cut in range(1, len(token)):
                if (a := ids.get(token[:cut])) is not None and (b := ids.get(token[cut:])) is not None:
                    self.joins[a << self.shift | b] = i
        rows = np.array([(key >> self.shift, key & (1 << self.shift) - 1, i) for key, i in self.joins.items()], dtype=np.int64).reshape(-1, 3)
        self.to_right, self.to_left = _partners(rows[:, 0], rows[:, 1], rows[:, 2], max(self.tokens) + 1), _partners(rows[:, 1], rows[:, 0], rows[:, 2], max(self.tokens) + 1)
        self.splits: dict[int, list[tuple[int, int]]] = {}
        for a, b, i in rows.tolist():
            self.splits.setdefault(i, []).append((a, b))
        # pairs of single bytes as a table: the first pairs of a block are looked up at once
        self.byte_joins = np.full(1 << 16, -1, dtype=np.int64)
        for token, i in ids.items():
            if len(token) == 2:
                self.byte_joins[token[0] << 8 | token[1]] = i
        self.decoder = Decoder(self.tokens)
        self.forget()

    # ------------------------------------------------------------ replay

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one behind another, and how many each has (no word is empty)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = len(data)
        symbols = np.append(self.byte_ids[data], -1)
        # neighbours: the position of the next symbol of the word, n behind its last; -1 before its first
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - sizes] = n, -1
        pairs = self.byte_joins[data[:-1].astype(np.int64) << 8 | data[1:]]
        pairs[ends[:-1] - 1] = -1
        index: dict[int, list] = {}
        at = np.flatnonzero(pairs >= 0)
        _enter(index, [], pairs[at], at)
        dirty = self._join_at_once(symbols, after, before, index)
        left = symbols[:-1].tolist()
        dirty |= self._join_one_by_one(left, after.tolist(), before.tolist(), {r: np.concatenate(e).tolist() for r, e in index.items()})
        symbols = np.array(left)
        for k in np.unique(np.searchsorted(ends, sorted(dirty), side="right")).tolist():
            own = symbols[ends[k] - sizes[k] : ends[k]]
            ids = self.replay_alone(words[k])
            own[:] = -1
            own[: len(ids)] = ids
        there = symbols >= 0
        return symbols[there], np.diff(np.cumsum(there)[ends - 1], prepend=0)

    def _join_at_once(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, index: dict[int, list]) -> set[int]:
        """Replays merges in rank order, all positions of an entry at once, while entries are large.

        Leaves the other entries in the index; returns a position of each word in which a join opened a pair of lower rank.
        """
        n = len(symbols) - 1
        dirty: list[np.ndarray] = []
        queue, few = list(index), 0
        heapq.heapify(queue)
        while queue and few < IN_A_ROW:
            rank = heapq.heappop(queue)
            at = np.sort(np.concatenate(index.pop(rank)))
            few = few + 1 if len(at) < FEW else 0
            j = after[at]
            fits = np.zeros(len(at), dtype=bool)
            for a, b in self.splits[rank]:
                fits |= (symbols[at] == a) & (symbols[j] == b)
            fits[1:] &= at[1:] != at[:-1]
            at, j = at[fits], j[fits]
            clash = at[1:] == j[:-1]  # the second symbol of a pair is the first of the next one
            if clash.any():
                own = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.concatenate(([True], ~clash)), own, 0))
                keep = (own - run) % 2 == 0  # every other pair of a run, from its left
                at, j = at[keep], j[keep]
            k = after[j]
            opened = self.to_right(rank, symbols[k])  # before joins further right
            dirty.append(at[(opened >= 0) & (opened < rank)])
            symbols[at], symbols[j] = rank, -1
            after[at] = k
            inner = k < n
            before[k[inner]] = at[inner]
            h = before[at]
            has = h >= 0
            h, own = h[has], at[has]
            lefts, rights = self.to_left(rank, symbols[h]), self.to_right(rank, symbols[k])
            dirty.append(own[(lefts >= 0) & (lefts < rank)])
            fresh = np.concatenate((lefts[lefts > rank], rights[rights > rank]))
            if len(fresh):
                _enter(index, queue, fresh, np.concatenate((h[lefts > rank], at[rights > rank])))
        return set(np.concatenate(dirty).tolist()) if dirty else set()

    def _join_one_by_one(self, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> set[int]:
        """The same for small entries, position by position."""
        joins, shift, n = self.joins, self.shift, len(symbols)
        dirty: set[int] = set()
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            for i in sorted(index.pop(rank)):
                j = after[i]
                if symbols[i] < 0 or j == n or joins.get(symbols[i] << shift | symbols[j]) != rank:
                    continue  # a neighbour has been joined since
                symbols[i], symbols[j] = rank, -1
                after[i] = k = after[j]
                if k != n:
                    before[k] = i
                for left in (before[i], i):
                    right = after[left] if left >= 0 else n
                    if right != n and (r := joins.get(symbols[left] << shift | symbols[right])) is not None:
                        if r < rank:
                            dirty.add(i)
                        elif (entry := index.get(r)) is not None:
                            entry.append(left)
                        else:
                            index[r] = [left]
                            heapq.heappush(queue, r)
        return dirty

    def replay_alone(self, word: bytes) -> list[int]:
        """Ids of one word, one join at a time: the lowest rank, then the leftmost."""
        symbols, n = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joins, shift = self.joins, self.shift
        queue = [(r, i) for i in range(n - 1) if (r := joins.get(symbols[i] << shift | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j == n or joins.get(symbols[i] << shift | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = rank, -1
            after[i] = k = after[j]
            if k != n:
                before[k] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) != n and (r := joins.get(symbols[left] << shift | symbols[right])) is not None:
                    heapq.heappush(queue, (r, left))
        return [s for s in symbols if s >= 0]

    # ------------------------------------------------------------ texts

    def forget(self) -> None:
        """Drops the words replayed so far."""
        self.slots: dict[str, int] = {}
        self.chars = 0
        self.flat, self.first, self.lengths = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, words: list[str]) -> None:
        """Gives new words their slots: whole tokens their ids, the others by one replay."""
        raw = [w.encode() for w in words]
        whole = [self.ids.get(b, -1) for b in raw]
        rest = [k for k, i in enumerate(whole) if i < 0]
        order = [k for k, i in enumerate(whole) if i >= 0] + rest
        flat = np.array([i for i in whole if i >= 0], dtype=np.int64)
        lengths = np.ones(len(flat), dtype=np.int64)
        if rest:
            more, each = self.replay([raw[k] for k in rest])
            flat, lengths = np.concatenate((flat, more)), np.concatenate((lengths, each))
        self.slots |= zip([words[k] for k in order], range(len(self.slots), len(self.slots) + len(order)))
        self.chars += sum(map(len, words))
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(lengths) - lengths))
        self.flat, self.lengths = np.concatenate((self.flat, flat)), np.concatenate((self.lengths, lengths))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind another, and where each text's begin (n+1 entries)."""
        found = [self.pattern.findall(t) for t in texts]
        words = list(chain.from_iterable(found))
        if len(self.slots) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.forget()
        if new := set(words).difference(self.slots):
            self.learn(list(new))
        of = np.array(list(map(self.slots.__getitem__, words)), dtype=np.int64)
        each = self.lengths[of]
        upto = np.cumsum(each)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.first[of] - (upto - each), each)
        return self.flat[at].astype(np.int32), np.concatenate(([0], upto))[np.cumsum([0, *map(len, found)])]

    def encode(self, text: str) -> list[int]:
        return self.encode_block([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return self.decoder(np.asarray(ids, dtype=np.int64))[0]


def _partners(own: np.ndarray, other: np.ndarray, joined: np.ndarray, size: int):
    """A function of a token and an array of neighbours that gives what each pair joins to (-1: nothing)."""
    order = np.lexsort((other, own))
    other, joined = other[order], joined[order]
    begins = np.searchsorted(own[order], np.arange(size + 1)).tolist()

    def look_up(token: int, neighbours: np.ndarray) -> np.ndarray:
        a, b = begins[token], begins[token + 1]
        if a == b:
            return np.full(len(neighbours), -1)
        at = np.minimum(np.searchsorted(other[a:b], neighbours), b - a - 1)
        return np.where(other[a:b][at] == neighbours, joined[a:b][at], -1)

    return look_up


def _enter(index: dict[int, list], queue: list[int], ranks: np.ndarray, at: np.ndarray) -> None:
    """Adds positions to the entries of their ranks, and new ranks to the queue."""
    order = np.argsort(ranks, kind="stable")
    ranks, at = ranks[order], at[order]
    bounds = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
    for a, b in zip(bounds, bounds[1:]):
        if a < b:
            rank = int(ranks[a])
            if rank in index:
                index[rank].append(at[a:b])
            else:
                index[rank] = [at[a:b]]
                heapq.heappush(queue, rank)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> MergeReplay:
    """The vocabulary of a file, once for each worker process."""
    return MergeReplay(path, pattern)


def blocks(batch: TextBatch) -> Iterator[list[bytes]]:
    """The texts of a batch in blocks of at most BLOCK_BYTES, or one longer text."""
    for run in batch.runs(BLOCK_BYTES):
        data, at = run.data.tobytes(), run.offsets.tolist()
        yield [data[a:b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Encodes a text column and decodes the ids again.

    Returns the columns ``keep`` (default: all) with ``n_tokens`` and, as asked
    for, ``ids`` (array<int>), ``decoded`` (binary), ``ids_sha256`` (of ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of bytes).
    """
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if ids else []
    new += [T.StructField("decoded", T.BinaryType())] if decoded else []
    new += [T.StructField(f"{k}_sha256", T.StringType()) for k in ("ids", "decoded")] if digests else []
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + new)
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, pattern)
        for batch in batches:
            row = 0
            for texts in blocks(TextBatch(batch.column(batch.num_columns - 1))):
                flat, at = vocabulary.encode_block([t.decode() for t in texts])
                arrays = [c.slice(row, len(texts)) for c in batch.columns[:-1]] + [pa.array(np.diff(at), pa.int64())]
                row += len(texts)
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())))
                if decoded or digests:
                    data, to = vocabulary.decoder(flat)
                    back = [data[to[a] : to[b]] for a, b in zip(at, at[1:])]
                    arrays += [pa.array(back, pa.binary())] if decoded else []
                if digests:
                    raw = flat.astype("<u4").tobytes()
                    arrays.append(pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at, at[1:])]))
                    arrays.append(pa.array([hashlib.sha256(b).hexdigest() for b in back]))
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)
    return map_batches(frame, run, schema)


def decode(frame: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of a column of ids."""
    kept = [f for f in frame.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    names = [f.name for f in kept]
    where = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path, pattern)
        for batch in batches:
            back = [None if x is None else vocabulary.decode(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=schema.names)

    return map_batches(frame.select(*names), run, schema)
