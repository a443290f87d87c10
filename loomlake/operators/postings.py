"""Keyword search by postings of character trigrams: chunks that cannot score are left out before they are scored.

A word is counted wherever it occurs as a substring, so a chunk scores for it
only if one of its fields holds all trigrams of the word.  The postings hold a
row for each chunk and trigram of any of its fields; a chunk is a candidate if
it has all trigrams of one of a question's words.  Candidates are scored by the
same expressions as in a scan, so results are equal.  A question with a word of
fewer than three characters, which postings cannot tell, is scored by a scan.

Postings belong to their chunk: a delta of the chunks is a delta of the postings
(``DeltaTable`` with the chunk's document as key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.text import tokens
from loomlake.operators.retrieval import Question, keyword_hits, ranked_chunks

GRAM = 3
#: Up to so many candidates are named to the scan of the chunks, which then skips the pages without them; more are joined.
NAMED = 1000


def grams_of(word: str) -> list[str]:
    return sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})


def _grams(text: Column) -> Column:
    """All trigrams of a text: an empty match at each place, with what follows."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1))


def build(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, gram): the distinct trigrams of each chunk's text, title, section and tags."""
    fields = [_grams(F.col(n)) for n in ("text", "title", "section_header") if n in chunks.columns]
    if "tags" in chunks.columns:
        fields.append(F.flatten(F.transform(F.coalesce("tags", F.array().cast("array<string>")), _grams)))
    return chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(F.concat(*fields))).alias("gram"))


def by_postings(question: Question) -> bool:
    words = tokens(question.text)
    return bool(words) and min(map(len, words)) >= GRAM


def candidates(postings: DataFrame, questions: list[Question]) -> DataFrame:
    """(doc_id, chunk_id) of the chunks that have all trigrams of some word of a question."""
    words = {w: grams_of(w) for q in questions for w in tokens(q.text)}
    asked = sorted({g for own in words.values() for g in own})
    rows = postings.where(F.col("gram").isin(asked))
    have = [F.count_if(F.col("gram").isin(own)).alias(f"w{i}") for i, own in enumerate(words.values())]
    full = F.lit(False)
    for i, own in enumerate(words.values()):
        full = full | (F.col(f"w{i}") == len(own))
    return rows.groupBy("doc_id", "chunk_id").agg(*have).where(full).select("doc_id", "chunk_id")


def pruned(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks among the candidates."""
    some = [r.chunk_id for r in found.select("chunk_id").limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        return chunks.where(F.col("chunk_id").isin(some) if some else F.lit(False))
    return chunks.join(found.select("chunk_id"), "chunk_id", "left_semi").select(chunks.columns)


def keyword_search(chunks: DataFrame, postings: DataFrame, questions: list[Question], k: int) -> DataFrame:
    """What ``retrieval.keyword_search`` gives over all chunks."""
    quick, slow = [q for q in questions if by_postings(q)], [q for q in questions if not by_postings(q)]
    hits = None
    if quick:
        hits = keyword_hits(pruned(chunks, candidates(postings, quick)), quick)
    if slow:
        rest = keyword_hits(chunks, slow)
        hits = rest if hits is None else hits.unionByName(rest)
    return ranked_chunks(chunks, hits, k)
