"""Chat formatting by token-level assembly.

Every turn is encoded on its own, row by row and without a shuffle: the escaped
text's ids, and the ids of the role.  A conversation's turns are then gathered
in order and spliced with reserved ids, which lie above the vocabulary and can
never result from encoding text:

    <|im_start|> role \\n text <|im_end|> \\n

The loss mask is derived by prefix sums over segment lengths: it covers the
text ids of assistant turns only.  Control strings in a text are escaped
reversibly before encoding: ``<|`` becomes ``<\\|``, and a backslash run between
``<`` and ``|`` grows by one, so that unescaping removes exactly one.  Roles are
escaped like texts, with ``\\n`` in a role written as ``\\\\n`` (and a backslash
doubled).

Rows are ordered by turn; rows of the same turn by role, then text; a null turn
comes first.  Null texts and roles count as empty, repeated rows count each, and
texts of any length are encoded whole.  A row with a null conversation id is a
conversation of its own, so that such rows, however many, do not meet.  A
conversation's tokens meet in one row, as they must in the result; no other rows do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm import bpe
from loomlake.llm.common import map_batches

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role), flags=re.DOTALL)


def reserved(vocabulary: bpe.ForcedBoundaryBPE) -> tuple[int, int]:
    """Ids of the two turn marks: the first two above the vocabulary."""
    top = max(vocabulary.tokens) + 1
    return top, top + 1


def encode_turns(rows: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn: conversation, turn, role and text as given (null: empty), and the ids of both."""
    schema = T.StructType([
        T.StructField("conv_id", rows.schema[conv].dataType), T.StructField("turn", rows.schema[turn].dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("role_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("text_ids", T.ArrayType(T.IntegerType(), False)),
    ])
    frame = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def changed(column: pa.Array, change) -> pa.Array:
        return pa.array([change(x) if "\\" in x or "<" in x else x for x in column.to_pylist()], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        for batch in batches:
            ids = [vocabulary.encode_column(texts, added_tokens=False) for texts in (pa.array([escape_role(x) for x in batch.column(2).to_pylist()], pa.string()), changed(batch.column(3), escape))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(lists(x, begins) for x, begins in ids)], names=schema.names)

    return map_batches(frame, run, schema)


def assemble(turns: DataFrame, path: str) -> DataFrame:
    """One row for each conversation: input_ids, loss_mask (0/1 for each id) and the formatted text."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "role_ids", "text_ids")))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    gathered = turns.select("*", lone).groupBy("conv_id", "lone").agg(ordered.alias("t"))
    schema = T.StructType([
        turns.schema["conv_id"], T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("loss_mask", T.ArrayType(T.ByteType(), False)), T.StructField("formatted", T.StringType()),
    ])
    slim = gathered.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: x["role_ids"]).alias("role_ids"), F.transform("t", lambda x: x["text_ids"]).alias("text_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.load(path)
        decoder = marked_decoder(path)
        start, end = reserved(vocabulary)
        newline = vocabulary.encode("\n")
        fixed = [np.array(x, dtype=np.int32) for x in ([start], newline, [end, *newline])]
        for batch in batches:
            conversations, roles = spans(batch.column(1))
            (role_ids, role_at), (text_ids, text_at) = (flat(batch.column(k)) for k in (2, 3))
            said = np.array([r == ASSISTANT for r in roles], dtype=bool)
            segments, lengths = [], []
            for k in range(len(said)):
                parts = (fixed[0], role_ids[role_at[k] : role_at[k + 1]], fixed[1], text_ids[text_at[k] : text_at[k + 1]], fixed[2])
                segments += parts
                lengths.append([len(p) for p in parts])
            ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
            ends = np.cumsum(np.array(lengths, dtype=np.int64).reshape(-1, 5)).reshape(-1, 5)
            steps = np.zeros(len(ids) + 1, dtype=np.int32)  # +1 where masked text begins, -1 where it ends
            np.add.at(steps, ends[said, 2], 1)
            np.add.at(steps, ends[said, 3], -1)
            mask = np.cumsum(steps[:-1]).astype(np.int8)
            begins = np.concatenate(([0], ends[:, 4] if len(ends) else []))[conversations].astype(np.int64)
            data, at = decoder(ids)
            texts = [data[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(begins, begins[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(ids, begins), lists(mask, begins), pa.array(texts, pa.string())], names=schema.names)

    return map_batches(slim, run, schema)


def lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values))


def spans(column: pa.Array) -> tuple[np.ndarray, list]:
    """Where each list of a column begins among the values of all (n+1 entries), and the values."""
    at = column.offsets.to_numpy()
    return at - at[0], column.values.slice(at[0], at[-1] - at[0]).to_pylist() if len(column) else []


def row_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each list begins (n+1 entries)."""
    at = column.offsets.to_numpy()
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists of lists, and where each inner list begins (n+1 entries)."""
    at = column.offsets.to_numpy()
    inner = column.values.slice(at[0], at[-1] - at[0])
    begins = inner.offsets.to_numpy()
    return inner.values.slice(begins[0], begins[-1] - begins[0]).to_numpy(zero_copy_only=False), begins - begins[0]


@lru_cache(maxsize=2)
def marked_decoder(path: str) -> bpe.Decoder:
    """Decodes ids of the vocabulary and the turn marks."""
    vocabulary = bpe.load(path)
    start, end = reserved(vocabulary)
    return bpe.Decoder({**vocabulary.tokens, start: START.encode(), end: END.encode()})


def format_conversations(rows: DataFrame, path: str, **columns: str) -> DataFrame:
    """Formats all conversations of a table of turns."""
    return assemble(encode_turns(rows, path, **columns), path)


def parse(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[list[tuple[str, str]], str]:
    """Reads turns (role, text) and the unescaped text under the loss mask back from a conversation's ids."""
    start, end = reserved(bpe.load(path))
    data, at = marked_decoder(path)(ids)
    said = lambda a, b: data[at[a] : at[b]].decode("utf-8", "replace")
    turns = []
    for a, b in zip(np.flatnonzero(ids == start).tolist(), np.flatnonzero(ids == end).tolist()):
        role, _, text = said(a + 1, b).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    # each masked run is one assistant text; adjacent runs cannot touch, marks lie between
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    loss = "".join(unescape(said(a, b)) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
    return turns, loss
