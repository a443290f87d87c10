"""Byte-pair encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never end up inside a
token, so a text may be cut between the two bytes: the fragments are encoded
independently and their ids concatenated.  Cuts are found for whole Arrow
batches at once with a 65,536-entry table.  A cut is used only where it also
leaves the pre-tokenizer's matches as they are in the whole text, that is

* not after white space (its match depends on what follows),
* not inside a UTF-8 character, and
* not before an apostrophe (it would look like the start of a contraction).

Fragments repeat a lot, so each worker keeps a bounded table of fragment
encodings; a fragment that is not in the table is pre-tokenized and merged by
rank with a heap, in O(n log n) for a fragment of any length.

Null texts count as empty and encode to no ids; invalid ids raise on decoding.
The strings of the tokenizer's own added tokens become their ids, as in the
tokenizers library, unless ``added_tokens=False``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlake.llm.common import SPACE, TextBatch, map_batches

#: The pre-tokenizer's pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: UTF-8 bytes of white space beyond ASCII and of the four information separators, after which no cut is used.
WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Fragments in each of the two generations that a worker keeps, and the longest that it keeps.
CACHE_FRAGMENTS, CACHE_BYTES = 150_000, 64


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in kept}
    for k, b in enumerate(b for b in range(256) if b not in set(kept)):
        table[chr(256 + k)] = b
    return table


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary with its table of byte pairs that force a cut."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(tok): i for tok, i in spec["model"]["vocab"].items()}
        self.tokens = {i: tok for tok, i in self.ids.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((raw(a), raw(b)), rank)
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.added_pattern = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.cuts = self.forced_pairs(self.ids)
        self.cache: dict[bytes, tuple[int, str, bytes]] = {}
        self.older: dict[bytes, tuple[int, str, bytes]] = {}

    @staticmethod
    def forced_pairs(vocabulary) -> np.ndarray:
        """For each byte pair (256 * left + right) whether a text may be cut between the two."""
        inside = np.zeros(1 << 16, dtype=bool)
        for tok in vocabulary:
            b = np.frombuffer(tok, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
        cuts = ~inside.reshape(256, 256)
        cuts[SPACE, :] = False
        cuts[:, 0x80:0xC0] = False
        cuts[:, ord("'")] = False
        return cuts.ravel()

    def cut_points(self, data: np.ndarray) -> np.ndarray:
        """Offsets in a byte array before which a fragment begins."""
        if len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        pairs = data[:-1].astype(np.uint16)
        pairs <<= np.uint16(8)
        pairs |= data[1:]
        return np.flatnonzero(self.cuts[pairs]) + 1

    def certain_cuts(self, data: np.ndarray, buf: bytes) -> np.ndarray:
        """The cut points of a byte array without those after white space beyond ASCII."""
        at = self.cut_points(data)
        if spaces := [m.end() for m in WIDE_SPACE.finditer(buf)]:
            at = at[~np.isin(at, spaces)]
        return at

    def fragments(self, text: bytes, cuts: np.ndarray | None = None) -> list[bytes]:
        """The independent fragments of a text."""
        at = self.certain_cuts(np.frombuffer(text, np.uint8), text) if cuts is None else cuts
        bounds = [0, *at.tolist(), len(text)]
        return [text[i:j] for i, j in zip(bounds, bounds[1:])]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: merges by lowest rank, then leftmost, over a linked list."""
        if (whole := self.ids.get(word)) is not None and len(word) < 2:
            return [whole]
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := left[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.ids[p] for p in parts if p is not None]

    def encode_fragment(self, fragment: bytes) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(fragment.decode("utf-8", "surrogateescape")):
            out += self.merge(m.group().encode("utf-8", "surrogateescape"))
        return out

    def entry(self, fragment: bytes) -> tuple[int, str, bytes]:
        """Number of ids, ids joined by commas, and the bytes that the ids decode to."""
        found = self.cache.get(fragment)
        if found is None:
            found = self.older.get(fragment)
            if found is None:
                ids = self.encode_fragment(fragment)
                back = b"".join([self.tokens[i] for i in ids])
                found = (len(ids), ",".join(map(str, ids)), fragment if back == fragment else back)
            if len(fragment) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_FRAGMENTS:
                    self.older = dict(self.cache)
                    self.cache.clear()
                self.cache[fragment] = found
        return found

    def pieces(self, text: bytes, added_tokens: bool = True) -> Iterator[bytes | int]:
        """Stretches of plain text and ids of added tokens."""
        if not added_tokens or self.added_pattern is None or not any(t in text for t in self.added):
            if text:
                yield text
            return
        at = 0
        for m in self.added_pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | bytes, added_tokens: bool = True) -> list[int]:
        text = text.encode("utf-8") if isinstance(text, str) else text
        out: list[int] = []
        for piece in self.pieces(text, added_tokens):
            if isinstance(piece, int):
                out.append(piece)
            else:
                for f in self.fragments(piece):
                    n, joined, _ = self.entry(f)
                    if n:
                        out += map(int, joined.split(","))
        return out

    def encode_column(self, texts: pa.Array, added_tokens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts one behind another, and where each text's ids begin (n+1 entries)."""
        ids, counts = [], [0]
        for n, joined, _ in _encoded(self, TextBatch(texts), added_tokens):
            ids.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, np.int32))
            counts.append(n)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.cumsum(counts)

    def decode_bytes(self, ids) -> bytes:
        return b"".join(self.tokens[int(i)] for i in ids)

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Decoder:
    """Decodes many ids at once: the bytes of all tokens one behind another, and where each begins."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens, default=-1) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        self.lengths[list(tokens)] = [len(t) for t in tokens.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = np.zeros(size, dtype=bool)
        self.known[list(tokens)] = True
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's begin (n+1 entries)."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise KeyError("an id that is no token")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.data[at].tobytes(), np.concatenate(([0], ends))


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """The vocabulary of a file, once for each worker process."""
    return ForcedBoundaryBPE(path)


def _encoded(bpe: ForcedBoundaryBPE, batch: TextBatch, added_tokens: bool) -> Iterator[tuple[int, str, bytes]]:
    """For each text of a batch: number of ids, joined ids, decoded bytes."""
    cache, entry = bpe.cache, bpe.entry
    for run in batch.runs():
        buf = run.data.tobytes()
        cuts = bpe.certain_cuts(run.data, buf)
        of = np.searchsorted(cuts, run.offsets)
        for i in range(len(run)):
            a, b = int(run.offsets[i]), int(run.offsets[i + 1])
            text = buf[a:b]
            at = cuts[of[i] : of[i + 1]] - a
            if len(at) and at[0] == 0:
                at = at[1:]
            if any(t in text for t in bpe.added) and added_tokens:
                found = [(1, str(p), bpe.tokens[p]) if isinstance(p, int) else entry(f) for p in bpe.pieces(text) for f in ([p] if isinstance(p, int) else bpe.fragments(p))]
            elif not text:
                found = []
            else:
                fragments = bpe.fragments(text, at)
                found = [cache.get(f) or entry(f) for f in fragments]
            yield sum([f[0] for f in found]), ",".join([f[1] for f in found]), b"".join([f[2] for f in found])


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True, decoded: bool = True, digests: bool = False, added_tokens: bool = True, exact: bool = False) -> DataFrame:
    """Encodes a text column and decodes the ids again.

    Returns the columns ``keep`` (default: all) with ``n_tokens`` and, as asked
    for, ``ids`` (array<int>), ``decoded`` (string), ``ids_sha256``,
    ``decoded_sha256`` and ``exact`` (whether the ids decode to the text).  No shuffle; one pass over Arrow batches.  Input columns
    of the same names as new ones are replaced.
    """
    new = [T.StructField("n_tokens", T.LongType())]
    if ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    if decoded:
        new.append(T.StructField("decoded", T.StringType()))
    if digests:
        new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if exact:
        new.append(T.StructField("exact", T.BooleanType()))
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    kept_names = [f.name for f in kept]
    schema = T.StructType(kept + new)
    frame = docs.select(*kept_names, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, out_ids, out_text, d1, d2, same = [], [], [], [], [], []
            texts = TextBatch(batch.column(batch.num_columns - 1))
            for i, (count, joined, back) in enumerate(_encoded(bpe, texts, added_tokens)):
                n.append(count)
                if exact:
                    same.append(back == texts.text(i))
                if ids:
                    out_ids.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, np.int32))
                whole = back.decode("utf-8", "replace") if decoded or digests else ""
                if decoded:
                    out_text.append(whole)
                if digests:
                    d1.append(hashlib.sha256(joined.encode()).hexdigest())
                    d2.append(hashlib.sha256(whole.encode()).hexdigest())
            arrays = [batch.column(k) for k in range(len(kept_names))] + [pa.array(n, pa.int64())]
            if ids:
                arrays.append(pa.array(out_ids, pa.list_(pa.int32())))
            if decoded:
                arrays.append(pa.array(out_text, pa.string()))
            if digests:
                arrays += [pa.array(d1, pa.string()), pa.array(d2, pa.string())]
            if exact:
                arrays.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(frame, run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids; null ids give a null text."""
    kept = [f for f in frame.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    names = [f.name for f in kept]
    where = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return map_batches(frame.select(*names), run, schema)
