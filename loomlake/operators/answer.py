"""From hits to an answer: pluggable embedding, reranking and generation around the retrieval plans.

Providers are small protocols.  Embedding and reranking may run in plans or on
the few rows of a question; generation runs on the driver for one prompt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions.text import round4, tokens
from loomlake.operators import retrieval


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    name: str

    def rerank(self, question: str, texts: list[str]) -> list[float | None]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic embeddings from hashed words, for use without a model."""

    size: int = 64
    name: str = "hash"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in tokens(t):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


@dataclass(frozen=True)
class LexicalReranker:
    """Share of the question's words that a text contains."""

    name: str = "lexical"

    def rerank(self, question: str, texts: list[str]) -> list[float | None]:
        words = set(tokens(question))
        return [len(words & set(tokens(t))) / len(words) if words else None for t in texts]


def check_index(meta: dict[str, str], provider: str, model: str) -> None:
    """Fails where an index was built by another provider or model; an index without metadata passes."""
    for key, own in (("provider", provider), ("model", model)):
        if meta.get(key) and meta[key] != own:
            raise ValueError(f"the index was built with {key} {meta[key]}, not {own}")


def source_objects(rows: DataFrame) -> DataFrame:
    """What is shown of each source: number, ids, title with fallbacks, section and score."""
    text = lambda *names: F.coalesce(*[F.when(F.trim(F.col(n).cast("string")) != "", F.trim(F.col(n).cast("string"))) for n in names if n in rows.columns], F.lit(None).cast("string"))
    return rows.select("query_id", F.col("rank").alias("source_number"), "doc_id", "chunk_id", text("title", "doc_id").alias("title"), text("section_header").alias("section_header"), round4(F.col("score")).alias("score"))


def promote(pairs: DataFrame, rules: DataFrame, existing: DataFrame | None = None, requested: list[str] | None = None) -> DataFrame:
    """Properties (page, name, value) promoted by rules (alias, name): the first value by name; an existing property wins.

    ``requested`` keeps the rules of which some alias is asked for.
    """
    if requested is not None:
        asked = rules.where(F.col("alias").isin(requested)).select("name").distinct()
        rules = rules.join(asked, "name", "left_semi")
    hits = pairs.join(rules, pairs["key"] == rules["alias"]).groupBy("page", "name").agg(F.min_by("value", "ord").alias("value"))
    return hits if existing is None else hits.join(existing.select("page", "name"), ["page", "name"], "left_anti").unionByName(existing.select("page", "name", "value"))


@dataclass(frozen=True)
class Builders:
    """How an answer's parts are made; replace what should differ.

    ``section`` makes a source's text (number, title, text, section header), ``context`` keeps the sections
    (query_id, rank, section) that fit, ``prompt`` puts question and context together (question, context,
    whether there are results), ``sources`` makes what is shown of each source.
    """

    section: Callable[..., Column] = retrieval.source_section
    context: Callable[[DataFrame], DataFrame] = retrieval.within_budget
    prompt: Callable[[Column, Column, Column], Column] = retrieval.prompt
    sources: Callable[[DataFrame], DataFrame] = source_objects


def ask(
    chunks: DataFrame, vectors: DataFrame, question: str, embedder: Embedder, reranker: Reranker | None = None, generator: Generator | None = None, k: int = retrieval.FINAL, builders: Builders | None = None,
) -> dict:
    """Answers one question: hybrid search, rerank, guardrail, dedupe, context, prompt, and the answer if there is a generator.

    At most CANDIDATES rows of one question reach the driver. Without hits no generator is called.
    """
    spark, build = chunks.sparkSession, builders or Builders()
    q = retrieval.Question(1, question, tuple(embedder.embed([question])[0]))
    hits = retrieval.with_chunks(retrieval.hybrid_search(chunks, vectors, [q]).drop("total"), chunks)
    rows = [r.asDict() for r in hits.orderBy("rank").collect()]
    if not rows:
        return {"prompt": None, "sources": [], "answer": retrieval.NO_ANSWER, "fallback": False}
    scores = reranker.rerank(question, [r["text"] or "" for r in rows]) if reranker else [r["score"] for r in rows]
    names = [c for c in ("rank", "chunk_id", "doc_id", "score", "title", "section_header", "source_ref", "text") if c in hits.columns]
    kinds = ", ".join(f"{n} {dict(hits.dtypes)[n]}" for n in names)
    scored = spark.createDataFrame([(1, *(r[n] for n in names), s) for r, s in zip(rows, scores)], f"query_id int, {kinds}, rerank_score double")
    scored = scored.withColumn("rerank_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")))
    fallback = bool(retrieval.guardrail(scored).first().fallback)
    exact: Column = F.contains(F.lower(F.concat_ws(" ", *[n for n in ("title", "section_header") if n in names], F.substring(F.coalesce("text", F.lit("")), 1, 500))), F.lit(question.strip().lower()))
    final = retrieval.blend(scored, exact, k).withColumn("rank", F.col("blend_rank") if fallback else F.col("rerank_rank"))
    there = lambda n, other: F.col(n) if n in names else other
    key = retrieval.dedupe_key(there("source_ref", F.lit("")), there("title", F.lit("")), there("section_header", F.lit("")), F.col("text"))
    final = retrieval.dedupe_backfill(final.withColumn("key", key), F.col("key"), k).withColumn("rank", F.col("final_rank"))
    title = F.coalesce(F.col("title"), F.col("doc_id").cast("string")) if "title" in names else F.col("doc_id").cast("string")
    final = final.withColumn("section", build.section(F.col("rank"), title, F.coalesce("text", F.lit("")), F.col("section_header") if "section_header" in names else None))
    context = build.context(final).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section"))).alias("s"))
    prompt = context.select(build.prompt(F.lit(question), F.array_join(F.transform("s", lambda x: x["section"]), "\n\n"), F.lit(True)).alias("p")).first()
    sources = [r.asDict() for r in build.sources(final).orderBy("source_number").collect()]
    prompt = prompt.p if prompt else None
    answer = None
    if generator and prompt:
        said = generator.generate(prompt)
        numbers = F.array(*[F.lit(s["source_number"]) for s in sources])
        answer = spark.range(1).select(retrieval.normalise_citations(F.lit(said), numbers).alias("a")).first().a
    return {"prompt": prompt, "sources": sources, "answer": answer, "fallback": fallback}
