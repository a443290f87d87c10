"""Keyword, vector and hybrid retrieval for a set of questions in one plan.

Questions are few and given by the caller; their terms become literals of one
projection over the chunks, so scoring is a scan without a join.  Every ranking
is a window by question, which Spark cuts to the best rows of each partition
before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions.text import occurrences, round4, strip, tokens

#: Weights of the keyword score, of fusion, and of the guardrail.
TEXT, TITLE, SECTION, TAG = 1.0, 2.5, 1.5, 1.2
PHRASE_TEXT, PHRASE_TITLE, PHRASE_SECTION = 1.5, 2.0, 1.0
COVERAGE_BOOST, PHRASE_BOOST, KEYWORD_BONUS = 0.25, 0.15, 0.35
LEAST_TOP, LEAST_SPREAD, EXACT_BONUS = 0.05, 0.03, 0.08
ALIASES = {
    "web": ["web", "website", "external_website", "scraping"],
    "website": ["web", "website", "external_website", "scraping"],
    "external_website": ["web", "website", "external_website", "scraping"],
    "file": ["file", "filesystem", "documents"],
    "filesystem": ["file", "filesystem", "documents"],
    "documents": ["file", "filesystem", "documents"],
}
CANDIDATES, FINAL = 100, 7


@dataclass(frozen=True)
class Question:
    query_id: int
    text: str
    vector: tuple[float, ...] = field(default=())


#: The best k of chunks or vectors for each question.
Search = Callable[[DataFrame, list[Question], int], DataFrame]


def _has(chunks: DataFrame, name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(""))) if name in chunks.columns else F.lit("")


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= max(1, k))


def keyword_hits(chunks: DataFrame, questions: list[Question]) -> DataFrame:
    """(doc_id, chunk_id, query_id, score) of the chunks that have a positive keyword score for a question."""
    base = chunks.withColumns({"_t": _has(chunks, "text"), "_h": _has(chunks, "title"), "_s": _has(chunks, "section_header")})
    tags = "tags" in chunks.columns

    def tag_count(word: str) -> Column:
        return F.aggregate(F.coalesce("tags", F.array().cast("array<string>")), F.lit(0), lambda n, t: n + occurrences(F.lower(t), word))

    def score(q: Question) -> Column:
        total = F.lit(0.0)
        words = tokens(q.text)
        for w in words:
            total = total + occurrences(F.col("_t"), w) * TEXT + occurrences(F.col("_h"), w) * TITLE + occurrences(F.col("_s"), w) * SECTION
            if tags:
                total = total + tag_count(w) * TAG
        if words:
            phrase = " ".join(words)
            for name, weight in (("_t", PHRASE_TEXT), ("_h", PHRASE_TITLE), ("_s", PHRASE_SECTION)):
                total = total + F.when(F.contains(F.col(name), F.lit(phrase)), F.lit(weight)).otherwise(F.lit(0.0))
        return round4(total)

    scored = F.array(*[F.struct(F.lit(q.query_id).alias("query_id"), score(q).alias("score")) for q in questions])
    return base.select("doc_id", "chunk_id", F.inline(F.filter(scored, lambda s: s["score"] > 0)))


def ranked_chunks(chunks: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The best k chunks of each question from keyword hits. Ids and scores are ranked; the texts of the winners are fetched after."""
    best = _ranked(hits, k, F.desc("score"), F.col("doc_id"), F.col("chunk_id"))
    # at most k rows for each question: a proven bound
    return chunks.join(F.broadcast(best), ["doc_id", "chunk_id"]).select(*chunks.columns, "query_id", "score", "rank")


def keyword_search(chunks: DataFrame, questions: list[Question], k: int) -> DataFrame:
    """The best k chunks of each question, by a scan."""
    return ranked_chunks(chunks, keyword_hits(chunks, questions), k)


def cosine(v: Column, q: tuple[float, ...]) -> Column:
    """Cosine similarity; 0 for different lengths or a zero norm."""
    query = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with(v, query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = F.lit(sum(float(x) * float(x) for x in q) ** 0.5)
    return F.when((F.size(v) == len(q)) & (norm > 0) & (size > 0), dot / (norm * size)).otherwise(F.lit(0.0))


def vector_hits(vectors: DataFrame, questions: list[Question], column: str = "embedding") -> DataFrame:
    base = vectors.withColumn("_v", F.col(column).cast("array<double>"))
    scored = F.array(*[F.struct(F.lit(q.query_id).alias("query_id"), cosine(F.col("_v"), q.vector).alias("score")) for q in questions])
    return base.drop(column).select(*[c for c in base.columns if c not in (column, "_v")], F.inline(F.filter(scored, lambda s: s["score"] > 0)))


def vector_search(vectors: DataFrame, questions: list[Question], k: int, column: str = "embedding") -> DataFrame:
    return _ranked(vector_hits(vectors, questions, column), k, F.desc("score"), F.col("doc_id"), F.col("chunk_id"))


def expand_sources(names: list[str]) -> list[str]:
    wanted = {n.strip().lower() for n in names if n.strip()}
    return sorted({a for n in wanted for a in ALIASES.get(n, [n])})


def source_filter(rows: DataFrame, names: list[str], column: str = "source_type") -> DataFrame:
    """Rows whose source, widened by its aliases, is allowed. Applied after a ranking, so it never widens it."""
    if not (allowed := expand_sources(names)):
        return rows
    reach = sorted({s for s in {*ALIASES, *allowed} if set(ALIASES.get(s, [s])) & set(allowed)})
    return rows.where(F.lower(F.trim(F.col(column))).isin(reach))


def lexical_boost(q: Question, haystack: Column) -> Column:
    words = sorted(set(tokens(q.text)))
    if not words:
        return F.lit(0.0)
    matched = sum((F.contains(haystack, F.lit(w)).cast("int") for w in words), F.lit(0))
    boost = matched / F.lit(float(len(words))) * COVERAGE_BOOST
    return round4(boost + F.when(F.contains(haystack, F.lit(q.text.strip().lower())), F.lit(PHRASE_BOOST)).otherwise(F.lit(0.0)))


def _normalised(rows: DataFrame) -> Column:
    top = F.max("score").over(W.partitionBy("query_id"))
    return F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, questions: list[Question], k: int = CANDIDATES, keyword_weight: float = 0.5, vector_weight: float = 0.5, sources: list[str] | None = None, by_word: Search = keyword_search, by_vector: Search = vector_search) -> DataFrame:
    """Weighted fusion of the best keyword and vector hits; one row for each question and chunk.

    ``by_word`` and ``by_vector`` find the best hits of each kind: scans, or searches by an index.
    """
    words, near = by_word(chunks, questions, k), by_vector(vectors, questions, k)
    if sources:
        kinds = chunks.select("chunk_id", "source_type")
        words, near = source_filter(words, sources), source_filter(near.join(kinds, "chunk_id", "left"), sources)
    haystack = F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "section_header", "text") if c in chunks.columns]))
    boost = F.lit(0.0)
    for q in questions:
        boost = F.when(F.col("query_id") == q.query_id, lexical_boost(q, haystack)).otherwise(boost)
    left = words.withColumns({"kw": _normalised(words), "boost": boost}).select("query_id", "chunk_id", "doc_id", (F.lit(keyword_weight) * F.col("kw") + F.lit(keyword_weight * KEYWORD_BONUS) + F.col("boost")).alias("ks"))
    right = near.withColumn("vn", _normalised(near)).select("query_id", "chunk_id", F.col("doc_id").alias("v_doc"), (F.lit(vector_weight) * F.col("vn")).alias("vs"))
    both = left.join(right, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", F.coalesce("doc_id", "v_doc").alias("doc_id"), (F.coalesce("ks", F.lit(0.0)) + F.coalesce("vs", F.lit(0.0))).alias("total"))
    # totals are ranked to nine digits: sums in another order must not change a rank
    ranked = _ranked(both.withColumn("total", F.floor(F.col("total") * 1e9 + 0.5) / 1e9), k, F.desc("total"), F.col("doc_id"), F.col("chunk_id"))
    return ranked.select("query_id", "rank", "doc_id", "chunk_id", round4(F.col("total")).alias("score"), "total")


def guardrail(rows: DataFrame) -> DataFrame:
    """Whether a question's rerank scores are too low or too flat: (query_id, fallback)."""
    g = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rerank_score").alias("scored"), F.max_by("rerank_score", F.when(F.col("rerank_score").isNotNull(), -F.col("rerank_rank"))).alias("top"), F.max_by("rerank_score", F.when(F.col("rerank_score").isNotNull(), F.col("rerank_rank"))).alias("low"))
    weak = (F.col("scored") < 2) | (F.col("top") < LEAST_TOP) | (F.col("top") - F.col("low") < LEAST_SPREAD)
    return g.select("query_id", ((F.col("n") >= 2) & weak).alias("fallback"))


def blend(rows: DataFrame, exact: Column, final_k: int | None = None) -> DataFrame:
    """Rows with blend_score from rerank, hybrid score, previous rank and an exact-match bonus, ranked anew.

    With ``final_k`` only reranked rows and the first 3 * final_k candidates take part; places count among all candidates.
    """
    n = F.count("*").over(W.partitionBy("query_id"))
    standing = F.greatest(F.lit(0.0), F.lit(1.0) - (F.coalesce(F.col("rank") - 1, n)) / n)
    s = F.lit(0.45) * F.coalesce("rerank_score", F.lit(0.0)) + F.lit(0.45) * F.col("score") + F.lit(0.10) * standing + F.when(exact, F.lit(EXACT_BONUS)).otherwise(F.lit(0.0))
    rows = rows.withColumn("blend_score", F.floor(s * 1e6 + 0.5) / 1e6)
    rows = rows if final_k is None else rows.where(F.col("rerank_score").isNotNull() | (F.col("rank") <= 3 * final_k))
    order = W.partitionBy("query_id").orderBy(F.desc("blend_score"), F.desc("rerank_score"), F.asc("rank"), F.desc("doc_id"), F.desc("chunk_id"))
    return rows.withColumn("blend_rank", F.row_number().over(order))


#: Characters of a text that tell it from others of the same source, title and section.
KEY_CHARS = 600


def dedupe_key(source_ref: Column, title: Column, section: Column, text: Column) -> Column:
    """What hits with the same passage share: source, title, section and the head of the text, without case and white space at the ends."""
    plain = lambda x: F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))
    head = F.lower(F.substring(strip(F.coalesce(text, F.lit(""))), 1, KEY_CHARS))
    return F.sha2(F.concat_ws("||", plain(source_ref), plain(title), plain(section), head), 256)


def dedupe_backfill(rows: DataFrame, key: Column, k: int = FINAL) -> DataFrame:
    """The first row of each key in rank order, filled up to k from the rows that follow, ranked anew."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("query_id", key).orderBy("rank"))).where("_n = 1").drop("_n")
    out = first.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return out.where(F.col("final_rank") <= k)


def source_section(number: Column, title: Column, text: Column, section: Column | None = None, tags: Column | None = None) -> Column:
    parts = [F.concat(F.lit("SOURCE "), number.cast("string")), F.concat(F.lit("Title: "), title)]
    if section is not None:
        parts.append(F.when(strip(section) != "", F.concat(F.lit("Section: "), strip(section))))
    if tags is not None:
        parts.append(F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))
    return strip(F.concat_ws("\n", *parts, F.lit(""), strip(text)))


def within_budget(rows: DataFrame, section: str = "section", most: int = 8000) -> DataFrame:
    """The longest prefix of each question's sections that fits, two characters between them."""
    used = F.sum(F.length(section) + 2).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)) - 2
    return rows.withColumn("used", used).where(F.col("used") <= most)


#: The prompt's parts.
PROMPT_HEAD = """SYSTEM / INSTRUCTIONS
Du bist ein QA-Assistent für lokale Wissensdaten.
Beantworte die Frage ausschließlich anhand des bereitgestellten CONTEXT.
Erfinde keine Informationen und nutze kein externes Wissen.
Wenn die Antwort im CONTEXT nicht enthalten ist, sage das klar und knapp.
Setze Zitationen direkt in die Antwort als [1], [2], ... passend zur Kontext-Nummerierung.

QUESTION
"""
PROMPT_TAIL = """

OUTPUT FORMAT
ANSWER
<kurze, präzise Antwort auf Basis des CONTEXT mit Zitationen [1], [2], ...>

Sources
[1] <Quellentitel>
[2] <Quellentitel>"""
NO_CONTEXT = "(Kontext konnte nicht aufgebaut werden. Nutze keine externen Informationen.)"
NO_RESULTS = "(Kein relevanter Kontext gefunden. Antworte mit: 'Die Antwort ist im Kontext nicht enthalten.')"
NO_ANSWER, NO_SOURCES = "Keine Antwort generiert.", "keine"


def prompt(question: Column, context: Column, has_results: Column) -> Column:
    own = strip(F.coalesce(context, F.lit("")))
    own = F.when(own != "", own).when(has_results, F.lit(NO_CONTEXT)).otherwise(F.lit(NO_RESULTS))
    return strip(F.concat(F.lit(PROMPT_HEAD), strip(question), F.lit("\n\nCONTEXT\n"), own, F.lit(PROMPT_TAIL)))


def normalise_citations(answer: Column, numbers: Column) -> Column:
    """[source N] as [N]; an answer without citations gets all of the given numbers."""
    text = F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"(?i)\[\s*source\s*(\d+)\s*\]", "[$1]")
    every = F.array_join(F.transform(F.array_sort(F.array_distinct(numbers)), lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), " ")
    said = F.when(text == "", F.lit(NO_ANSWER)).otherwise(text)
    return F.when(text.rlike(r"\[\d+\]") | (every == ""), said).otherwise(F.concat(said, F.lit(" "), every))


#: The title of a source without one.
NO_TITLE = "Unbekannte Quelle"


def _numbers(sources: Column) -> Column:
    """Sources with their number n: their own if it is positive, else their place."""
    return F.transform(sources, lambda s, i: s.withField("n", F.when(s["source_number"] > 0, s["source_number"]).otherwise(i + 1)))


def citation_map(sources: Column) -> Column:
    """map<chunk_id, number> of an array of sources (source_number, chunk_id, ...); of sources of one chunk the last counts."""
    rows = F.filter(_numbers(sources), lambda s: F.trim(F.coalesce(s["chunk_id"], F.lit(""))) != "")
    last = F.filter(rows, lambda s, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda later: F.trim(later["chunk_id"]) == F.trim(s["chunk_id"])))
    return F.map_from_entries(F.transform(last, lambda s: F.struct(F.trim(s["chunk_id"]), s["n"].cast("int"))))


def sources_block(sources: Column) -> Column:
    """One line for each source, by number: [n] title – section."""
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    label = lambda s: F.concat(F.coalesce(F.when(text(s["title"]) != "", text(s["title"])), F.when(text(s["doc_id"].cast("string")) != "", text(s["doc_id"].cast("string"))), F.lit(NO_TITLE)), F.when(text(s["section_header"]) != "", F.concat(F.lit(" – "), text(s["section_header"]))).otherwise(""))
    lines = F.transform(_numbers(sources), lambda s, i: F.struct(s["n"].cast("int").alias("n"), i.alias("i"), F.concat(F.lit("["), s["n"].cast("int").cast("string"), F.lit("] "), label(s)).alias("line")))
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")


def formatted_answer(answer: Column, sources: Column) -> Column:
    """The answer with normalised citations and its sources."""
    block = sources_block(sources)
    said = normalise_citations(answer, F.map_values(citation_map(sources)))
    return F.concat(F.lit("ANSWER\n\n"), said, F.lit("\n\nSources\n"), F.when(block == "", F.lit(NO_SOURCES)).otherwise(block))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's columns; a hit whose chunk is gone stays, titled by its document."""
    own = chunks.withColumnRenamed("doc_id", "_doc")
    rows = hits.join(own, "chunk_id", "left").withColumn("doc_id", F.coalesce("_doc", "doc_id")).drop("_doc")
    return rows.withColumn("title", F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("doc_id").cast("string"))) if "title" in rows.columns else rows


def search(chunks: DataFrame, vectors: DataFrame | None, questions: list[Question], mode: str = "hybrid", k: int = 5, by_word: Search = keyword_search, by_vector: Search = vector_search, **options) -> DataFrame:
    """The best k chunks of each question by mode: keyword, vector or hybrid."""
    if mode == "keyword":
        return by_word(chunks, questions, k)
    if vectors is None:
        raise ValueError(f"{mode} search needs vectors")
    if mode == "vector":
        return with_chunks(by_vector(vectors, questions, k), chunks)
    if mode == "hybrid":
        return with_chunks(hybrid_search(chunks, vectors, questions, k, by_word=by_word, by_vector=by_vector, **options), chunks)
    raise ValueError(f"unknown mode {mode}")
