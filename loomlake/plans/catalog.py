"""The registered queries of the engine and the SQL that checks them, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import frontmatter
from loomlake.functions import text as tx
from loomlake.operators import answer, audit, chunking, convert, markup, pages, postings, retrieval, scrape, state, terminology, vector_index
from loomlake.plans import views
from loomlake.runtime import ensure_package, shared_dir
from loomlake.sources import readers
from loomlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
K = 10
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---------------------------------------------------------------- chunking


@query(f"WITH {views.CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(chunk_start AS INTEGER) AS chunk_start, CAST(chunk_end AS INTEGER) AS chunk_end, chunk_id, text FROM chunks WHERE text <> ''")
def chunk_simple(spark, sf_dir):
    return views.chunks(spark, sf_dir)


_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x85\xa0]+|[\s\x0b\x1c-\x1f\x85\xa0]+$', '', 'g')"
_SECTIONS_SQL = views.MARKDOWN_SQL + r""",
lines AS (
  SELECT doc_id, unnest(string_split_regex(""" + _STRIP.format("body") + r""", '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line,
         generate_subscripts(string_split_regex(""" + _STRIP.format("body") + r""", '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS i FROM md
), marked AS (
  SELECT *, regexp_matches(line, '^#{1,6}\s+') AS head, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM lines
), secs AS (
  SELECT doc_id, sec, coalesce(max(regexp_replace(line, '^#{1,6}\s+', '')) FILTER (head), '') AS header,
         coalesce(max(length(regexp_extract(line, '^(#+)', 1))) FILTER (head), 0) AS level,
         """ + _STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '')") + r""" AS content
  FROM marked GROUP BY doc_id, sec
)"""


@query(f"WITH {_SECTIONS_SQL} SELECT doc_id, {_STRIP.format('header')} AS header, CAST(level AS INTEGER) AS level, content FROM secs WHERE header <> '' OR content <> ''")
def chunk_markdown_sections(spark, sf_dir):
    md = views.markdown(spark, sf_dir)
    return md.select("doc_id", F.inline(chunking.sections(tx.strip(c("body")))))


_MERGED_SQL = _SECTIONS_SQL + f""",
own AS (
  SELECT doc_id, sec, {_STRIP.format('header')} AS header, level, content FROM secs WHERE header <> '' OR content <> ''
), said AS (
  SELECT *, CASE WHEN header = '' THEN content ELSE repeat('#', level) || ' ' || header || CASE WHEN content = '' THEN '' ELSE chr(10) || content END END AS rendered,
         row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS place FROM own
), grouped AS (
  SELECT *, sum(CASE WHEN place = 1 OR length(rendered) >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS part FROM said
), merged AS (
  SELECT doc_id, part, min_by(header, sec) AS header, min_by(level, sec) AS level,
         concat_ws(chr(10) || chr(10), nullif(min_by(content, sec), ''), string_agg(rendered, chr(10) || chr(10) ORDER BY sec) FILTER (place > 1 AND length(rendered) < 200)) AS content
  FROM grouped GROUP BY doc_id, part
), whole AS (
  SELECT doc_id, part, header, level, CASE WHEN header = '' THEN content ELSE repeat('#', level) || ' ' || header || CASE WHEN content = '' THEN '' ELSE chr(10) || content END END AS t FROM merged
), cut AS (
  SELECT *, unnest(range(0, CASE WHEN length(t) <= 1200 THEN 1 ELSE length(t) END, 1100)) AS st FROM whole WHERE t <> ''
), pieces AS (
  SELECT doc_id, part, st, header, level, {_STRIP.format('substring(t, st + 1, 1200)')} AS text FROM cut WHERE st = 0 OR st + 100 < length(t)
)"""


@query(f"WITH {_MERGED_SQL} SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(st AS INTEGER) AS chunk_start, header AS section_header, CAST(level AS INTEGER) AS section_level, text FROM pieces WHERE text <> ''")
def chunk_markdown_merged(spark, sf_dir):
    return chunking.markdown_chunks(views.markdown(spark, sf_dir))


@query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?m)^[ \t]*[^\s#]') OR regexp_matches(coalesce(text, ''), '(?m)^[ \t]*(#{7,}|#{1,6}[^#\s])') AS meaningful FROM documents")
def quality_filter(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.has_meaningful_content(F.coalesce("text", F.lit(""))).alias("meaningful"))


# ---------------------------------------------------------------- retrieval


def _count(haystack: str, token: str = "tok") -> str:
    return f"CAST((length({haystack}) - length(replace({haystack}, {token}, ''))) / length({token}) AS INTEGER)"


_KEYWORD_SQL = views.WHOLE_SQL + f""",
kw_tokens AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM q),
kw_parts AS (
  SELECT query_id, doc_id, sum({_count('lower(coalesce(text, $$$$))')} * 1.0::DOUBLE + {_count('lower(title)')} * 2.5::DOUBLE + {_count('lower(section_header)')} * 1.5::DOUBLE
         + list_sum(list_transform(tags, lambda t: {_count('lower(t)')})) * 1.2::DOUBLE) AS s
  FROM whole, kw_tokens GROUP BY ALL
), kw_scored AS (
  SELECT w.*, q.query_id, floor((p.s + CASE WHEN contains(lower(coalesce(text, '')), lower(query)) THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(title), lower(query)) THEN 2.0::DOUBLE ELSE 0 END
         + CASE WHEN contains(lower(section_header), lower(query)) THEN 1.0::DOUBLE ELSE 0 END) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS score
  FROM whole w JOIN kw_parts p USING (doc_id) JOIN q USING (query_id)
), kw AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM kw_scored WHERE score > 0
)""".replace("$$$$", "''")


@query(f"WITH {_KEYWORD_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score FROM kw WHERE rank <= {K}")
def keyword_topk(spark, sf_dir):
    hits = retrieval.keyword_search(views.whole(spark, sf_dir), views.questions(spark, sf_dir), K)
    return hits.select("query_id", "rank", "doc_id", "chunk_id", "score")


_VECTOR_SQL = """
qv AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0),
vs AS (SELECT vec_id AS doc_id, CAST(vec_id AS VARCHAR) AS chunk_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qv.v) AS score FROM embeddings, qv),
vec AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_id) AS rank FROM vs WHERE score > 0)"""


@query(f"WITH {_VECTOR_SQL} SELECT 1 AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, floor(score * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS score FROM vec WHERE rank <= {K}")
def vector_topk(spark, sf_dir):
    asked = [q for q in views.questions(spark, sf_dir, vectors_too=True) if q.query_id == 1]
    hits = retrieval.vector_search(views.vectors(spark, sf_dir), asked, K)
    return hits.select("query_id", "rank", "doc_id", "chunk_id", tx.round4(c("score")).alias("score"))


@query(f"WITH {_KEYWORD_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score FROM kw WHERE rank <= {K}")
def keyword_topk_postings(spark, sf_dir):
    """As ``keyword_topk``, by trigram postings of all chunks, which each task sorts and writes by itself."""
    chunks = views.whole(spark, sf_dir)
    path = f"{shared_dir(spark)}/loomlake/postings-{uuid.uuid4().hex}"
    postings.build(chunks).sortWithinPartitions("gram").write.parquet(path)
    hits = postings.keyword_search(chunks, spark.read.parquet(path), views.questions(spark, sf_dir), K)
    return hits.select("query_id", "rank", "doc_id", "chunk_id", "score")


@query(f"WITH {_VECTOR_SQL} SELECT 1 AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, floor(score * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS score FROM vec WHERE rank <= {K}")
def vector_topk_cells(spark, sf_dir):
    """As ``vector_topk``, by an index of all vectors in cells."""
    asked = [q for q in views.questions(spark, sf_dir, vectors_too=True) if q.query_id == 1]
    path = f"{shared_dir(spark)}/loomlake/cells-{uuid.uuid4().hex}"
    vector_index.build(views.vectors(spark, sf_dir), path)
    hits = vector_index.VectorIndex(spark, path).search(asked, K)
    return hits.select("query_id", "rank", "doc_id", "chunk_id", tx.round4(c("score")).alias("score"))


def _hybrid_sql(k: int, sources: str = "") -> str:
    keep = f"WHERE rank <= {k}" + (f" AND {sources}" if sources else "")
    keep_v = f"WHERE rank <= {k}" + (f" AND (SELECT any_value(source_type) FROM whole w WHERE w.chunk_id = vec.chunk_id) IN ('website')" if sources else "")
    return _KEYWORD_SQL + "," + _VECTOR_SQL + f""",
k1 AS (
  SELECT kw.query_id, chunk_id, doc_id, 0.5::DOUBLE * (score / max(score) OVER (PARTITION BY kw.query_id)) + 0.175::DOUBLE
         + floor((len(list_filter(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')), lambda t: contains(h, t)))
                  / len(list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')))::DOUBLE * 0.25::DOUBLE
                  + CASE WHEN contains(h, lower(trim(query))) THEN 0.15::DOUBLE ELSE 0 END) * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS ks
  FROM (SELECT *, lower(concat_ws(' ', nullif(title, ''), nullif(section_header, ''), nullif(text, ''))) AS h FROM kw) kw JOIN q USING (query_id) {keep}
), v1 AS (
  SELECT query_id, chunk_id, doc_id, 0.5::DOUBLE * (score / max(score) OVER (PARTITION BY query_id)) AS vs FROM vec, q {keep_v}
), fused AS (
  SELECT coalesce(k1.query_id, v1.query_id) AS query_id, coalesce(k1.chunk_id, v1.chunk_id) AS chunk_id, coalesce(k1.doc_id, v1.doc_id) AS doc_id,
         floor((coalesce(ks, 0) + coalesce(vs, 0)) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS total
  FROM k1 FULL JOIN v1 ON k1.query_id = v1.query_id AND k1.chunk_id = v1.chunk_id
), hybrid AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id, chunk_id) AS rank, floor(total * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE AS score FROM fused
)"""


def _hybrid(spark, sf_dir, **options):
    return retrieval.hybrid_search(views.whole(spark, sf_dir), views.vectors(spark, sf_dir), views.questions(spark, sf_dir, vectors_too=True), **options)


@query(f"WITH {_hybrid_sql(100)} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score FROM hybrid WHERE rank <= 100")
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "rank", "doc_id", "chunk_id", "score")


@query(f"WITH {_hybrid_sql(100, chr(115) + 'ource_type IN (' + chr(39) + 'website' + chr(39) + ')')} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score FROM hybrid WHERE rank <= 100")
def hybrid_source_filter(spark, sf_dir):
    return _hybrid(spark, sf_dir, sources=["web"]).select("query_id", "rank", "doc_id", "chunk_id", "score")


_RERANK = "((doc_id * 7919 + query_id * 104729) % 1000) / 1000.0::DOUBLE"


def _reranked(spark, sf_dir):
    score = F.pmod(c("doc_id") * 7919 + c("query_id") * 104729, F.lit(1000)) / F.lit(1000.0)
    rows = _hybrid(spark, sf_dir).withColumn("rerank_score", F.when(c("query_id") == 3, score / 1000).otherwise(score))
    order = F.row_number().over(retrieval.W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    return rows.withColumn("rerank_rank", order)


@query(f"""WITH {_hybrid_sql(100)}, r AS (
  SELECT *, CASE WHEN query_id = 3 THEN {_RERANK} / 1000 ELSE {_RERANK} END AS rerank_score, count(*) OVER (PARTITION BY query_id) AS n FROM hybrid WHERE rank <= 100
), g AS (SELECT query_id, count(*) >= 2 AND (max(rerank_score) < 0.05 OR max(rerank_score) - min(rerank_score) < 0.03) AS fallback FROM r GROUP BY query_id),
b AS (SELECT r.*, floor((0.45::DOUBLE * rerank_score + 0.45::DOUBLE * score + 0.10::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (rank - 1)::DOUBLE / n::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS blend_score FROM r)
SELECT query_id, doc_id, chunk_id, fallback, blend_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend_score DESC, rerank_score DESC, rank, doc_id DESC, chunk_id DESC) AS INTEGER) AS blend_rank FROM b JOIN g USING (query_id)""")
def guardrail_blend(spark, sf_dir):
    rows = _reranked(spark, sf_dir)
    return retrieval.blend(rows, F.lit(False)).join(retrieval.guardrail(rows), "query_id").select("query_id", "doc_id", "chunk_id", "fallback", "blend_score", "blend_rank")


_SECTION_SQL = r"""trim('SOURCE ' || final_rank || chr(10) || 'Title: ' || title || CASE WHEN section_header <> '' THEN chr(10) || 'Section: ' || section_header ELSE '' END || chr(10) || 'Tags: ' || array_to_string(list_filter(tags, lambda t: t <> ''), ', ') || chr(10) || chr(10) || """ + _STRIP.format("coalesce(text, '')") + ")"
_FINAL_SQL = f"""{_hybrid_sql(100)}, f1 AS (
  SELECT h.query_id, h.rank, h.chunk_id, w.*, row_number() OVER (PARTITION BY h.query_id, sha256(concat_ws('||', lower(w.source_type), lower(trim(title)), lower(trim(section_header)), lower(substring({_STRIP.format("coalesce(text, '')")}, 1, 600)))) ORDER BY h.rank) AS n
  FROM hybrid h JOIN whole w USING (chunk_id) WHERE h.rank <= 100
), f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM f1 WHERE n = 1), final AS (SELECT * FROM f2 WHERE final_rank <= 7)
"""


def _final(spark, sf_dir):
    rows = _hybrid(spark, sf_dir).drop("doc_id").join(views.whole(spark, sf_dir), "chunk_id")
    key = retrieval.dedupe_key(c("source_type"), c("title"), c("section_header"), c("text"))
    return retrieval.dedupe_backfill(rows.withColumn("key", key), c("key"))


@query(f"WITH {_FINAL_SQL} SELECT query_id, CAST(final_rank AS INTEGER) AS final_rank, CAST(rank AS INTEGER) AS rank, doc_id FROM final")
def dedupe_backfill(spark, sf_dir):
    return _final(spark, sf_dir).select("query_id", "final_rank", "rank", "doc_id")


def _context(spark, sf_dir):
    rows = _final(spark, sf_dir)
    tags = F.filter("tags", lambda t: t != "")
    rows = rows.withColumns({"rank": c("final_rank"), "section": retrieval.source_section(c("final_rank"), c("title"), F.coalesce("text", F.lit("")), c("section_header"), tags)})
    return retrieval.within_budget(rows)


_CONTEXT_SQL = f"""{_FINAL_SQL}, ctx1 AS (SELECT *, {_STRIP.format(_SECTION_SQL)} AS section FROM final),
ctx2 AS (SELECT *, sum(length(section) + 2) OVER (PARTITION BY query_id ORDER BY final_rank) - 2 AS used FROM ctx1), ctx AS (SELECT * FROM ctx2 WHERE used <= 8000)"""


@query(f"WITH {_CONTEXT_SQL} SELECT query_id, CAST(final_rank AS INTEGER) AS rank, doc_id, CAST(used AS BIGINT) AS used, sha256(section) AS section_hash FROM ctx")
def context_budget(spark, sf_dir):
    return _context(spark, sf_dir).select("query_id", "rank", "doc_id", "used", F.sha2("section", 256).alias("section_hash"))


@query(f"""WITH {_CONTEXT_SQL}, p AS (SELECT query_id, string_agg(section, chr(10) || chr(10) ORDER BY final_rank) AS context, CAST(count(*) AS BIGINT) AS sources, string_agg('[' || final_rank || '] ' || title, chr(10) ORDER BY final_rank) AS listed FROM ctx GROUP BY query_id)
SELECT query_id, sha256('{retrieval.PROMPT_HEAD}' || query || chr(10) || chr(10) || 'CONTEXT' || chr(10) || coalesce(context, '{retrieval.NO_RESULTS.replace("'", "''")}') || '{retrieval.PROMPT_TAIL}') AS prompt_hash, coalesce(sources, 0) AS sources, listed FROM q LEFT JOIN p USING (query_id)""")
def prompt_and_sources(spark, sf_dir):
    g = _context(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "section", "title"))).alias("s"))
    asked = spark.createDataFrame(views.QUERIES, "query_id int, query string").join(g, "query_id", "left")
    context = F.array_join(F.transform("s", lambda x: x["section"]), "\n\n")
    listed = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["title"])), "\n")
    return asked.select("query_id", F.sha2(retrieval.prompt(c("query"), context, F.size("s") > 0), 256).alias("prompt_hash"), F.greatest(F.lit(0), F.coalesce(F.size("s"), F.lit(0))).cast("long").alias("sources"), listed.alias("listed"))


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace(""" + _STRIP.format("CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN coalesce(text, '') || ' [Source ' || turn || ']' ELSE coalesce(text, '') END") + r""", '(?i)\[\s*source\s*(\d+)\s*\]', '[\1]', 'g') AS t FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(t, '\[\d+\]') THEN t ELSE CASE WHEN t = '' THEN 'Keine Antwort generiert.' ELSE t END || ' [1] [2]' END) AS answer_hash FROM a""")
def citation_normalise(spark, sf_dir):
    rows = views.table(spark, sf_dir, "conversations")
    said = F.coalesce("text", F.lit(""))
    answer = F.when(c("turn") % 3 == 0, "").when(c("turn") % 3 == 1, F.concat(said, F.lit(" [Source "), c("turn").cast("string"), F.lit("]"))).otherwise(said)
    return rows.select("conv_id", "turn", F.sha2(retrieval.normalise_citations(answer, F.array(F.lit(2), F.lit(1), F.lit(2))), 256).alias("answer_hash"))


# ---------------------------------------------------------------- audit

_OK = "status IN ('ok', 'warning')"
_DOCS = "CAST(count(DISTINCT CASE WHEN {} THEN document_id END) AS BIGINT)"
_FUNNEL_SQL = views.EVENTS_SQL + f""",
same AS (SELECT DISTINCT run_id, document_id FROM ev WHERE stage = 'filter' AND status = 'skipped' AND reason_code IN ('unchanged_incremental', 'unchanged_source')),
f0 AS (
  SELECT run_id, {_DOCS.format(f"stage = 'discover' AND {_OK}")} AS discovered, {_DOCS.format(f"stage = 'load' AND {_OK}")} AS loaded,
         {_DOCS.format("stage = 'filter' AND status = 'skipped' AND reason_code IN ('unchanged_incremental', 'unchanged_source')")} AS unchanged_skipped,
         {_DOCS.format("stage = 'filter' AND status = 'skipped' AND (run_id, document_id) NOT IN (SELECT (run_id, document_id) FROM same)")} AS filtered_skipped,
         {_DOCS.format("stage = 'transform' AND status = 'error'")} AS transform_failed, {_DOCS.format(f"stage = 'transform' AND {_OK}")} AS transformed_ok, {_DOCS.format(f"stage = 'chunk' AND {_OK}")} AS chunked_docs,
         CAST(coalesce(sum(chunk_count) FILTER (stage = 'chunk' AND {_OK}), 0) AS BIGINT) AS chunks_created, CAST(coalesce(sum(output_count) FILTER (stage = 'embed' AND {_OK}), 0) AS BIGINT) AS embedded_chunks,
         CAST(coalesce(sum(output_count) FILTER (stage = 'index' AND {_OK}), 0) AS BIGINT) AS indexed_chunks
  FROM ev GROUP BY run_id
), f1 AS (SELECT *, greatest(0, loaded - unchanged_skipped) AS candidate_for_transform FROM f0),
funnel AS (SELECT *, greatest(0, loaded - candidate_for_transform) AS expected_dropoff, greatest(0, candidate_for_transform - transformed_ok) AS problematic_dropoff FROM f1)"""
_TYPES_SQL = """types AS (
  SELECT run_id, CASE WHEN bool_or(stage = 'index') AND NOT bool_or(stage = 'transform') THEN 'index' WHEN bool_or(stage = 'embed') AND NOT bool_or(stage = 'transform') THEN 'ingest'
                      WHEN bool_or(stage = 'transform') THEN 'transform' WHEN bool_or(stage = 'chunk') THEN 'chunk' ELSE 'mixed' END AS run_type
  FROM ev GROUP BY run_id)"""


@query(f"WITH {_FUNNEL_SQL} SELECT * FROM funnel")
def audit_funnel(spark, sf_dir):
    return audit.funnel(views.events(spark, sf_dir))


@query(f"""WITH {_FUNNEL_SQL} SELECT run_id, 'loaded' AS from_step, 'candidate_for_transform' AS to_step, greatest(0, loaded - candidate_for_transform) AS drop_count FROM funnel
UNION ALL SELECT run_id, 'candidate_for_transform', 'transformed_ok', greatest(0, candidate_for_transform - transformed_ok) FROM funnel
UNION ALL SELECT run_id, 'transformed_ok', 'chunked_docs', greatest(0, transformed_ok - chunked_docs) FROM funnel""")
def audit_dropoff(spark, sf_dir):
    return audit.drop_offs(audit.funnel(views.events(spark, sf_dir)))


@query(f"""WITH {_FUNNEL_SQL}, {_TYPES_SQL} SELECT run_id, run_type, candidate_for_transform, expected_dropoff, problematic_dropoff,
CASE WHEN unchanged_skipped >= filtered_skipped + transform_failed THEN 'loaded->candidate_for_transform' ELSE 'candidate_for_transform->transformed_ok' END AS largest_loss,
CASE WHEN run_type IN ('transform', 'chunk', 'mixed') THEN transformed_ok / greatest(1, loaded)::DOUBLE END AS transform_quote,
CASE WHEN run_type IN ('transform', 'chunk', 'mixed') THEN chunked_docs / greatest(1, transformed_ok)::DOUBLE END AS chunk_quote,
CASE WHEN run_type IN ('index', 'mixed') AND chunks_created > 0 THEN indexed_chunks / chunks_created::DOUBLE END AS index_quote FROM funnel JOIN types USING (run_id)""")
def audit_quality(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return audit.quality(audit.funnel(e), audit.run_types(e.select("run_id"), e))


@query(f"WITH {views.EVENTS_SQL}, {_TYPES_SQL} SELECT * FROM types")
def audit_run_types(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return audit.run_types(e.select("run_id"), e)


@query(f"WITH {views.EVENTS_SQL} SELECT stage, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in audit.STATUSES) + " FROM ev GROUP BY stage")
def audit_stage_stats(spark, sf_dir):
    return audit.stage_stats(views.events(spark, sf_dir))


@query(f"""WITH {views.EVENTS_SQL}, r AS (SELECT * FROM ev WHERE reason_code IS NOT NULL)
SELECT reason_code, 'all' AS by, '' AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT reason_code, 'stage', stage, count(*) FROM r GROUP BY ALL UNION ALL SELECT reason_code, 'run', run_id, count(*) FROM r GROUP BY ALL""")
def audit_reasons(spark, sf_dir):
    return audit.reasons(views.events(spark, sf_dir))


@query(f"""WITH {views.EVENTS_SQL}, r AS (SELECT * FROM ev WHERE reason_code IS NOT NULL), d AS (SELECT reason_code, document_id, min((created_at, id)) AS seen_at FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY reason_code ORDER BY seen_at) AS rn FROM d), x AS (SELECT reason_code, string_agg(document_id, '|' ORDER BY rn) AS examples FROM k WHERE rn <= 5 GROUP BY reason_code)
SELECT reason_code, n, examples FROM (SELECT reason_code, count(*) AS n FROM r GROUP BY reason_code) JOIN x USING (reason_code)""")
def audit_reason_examples(spark, sf_dir):
    return audit.reason_examples(views.events(spark, sf_dir))


@query(f"""WITH {views.EVENTS_SQL} SELECT document_id, document_title AS title, stage, status, reason_code, message FROM ev
WHERE status <> 'ok' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1""")
def audit_problem_documents(spark, sf_dir):
    return audit.problem_documents(views.events(spark, sf_dir))


_DRILL_SQL = f"""WITH {views.EVENTS_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY run_id, document_id ORDER BY created_at DESC, id DESC) = 1),
m AS (SELECT run_id, document_id, arg_max(input_count, (created_at, id)) FILTER (input_count IS NOT NULL) AS raw_text_length,
             arg_max(output_count, (created_at, id)) FILTER (stage = 'transform' AND output_count IS NOT NULL) AS transformed_text_length,
             arg_max(chunk_count, (created_at, id)) FILTER (chunk_count IS NOT NULL) AS chunk_count,
             CASE WHEN bool_or(reason_code = 'unsupported_macro') THEN 'unsupported_macro' END AS warning_flags,
             CASE WHEN bool_or(coalesce(reason_code, '') = 'unchanged_incremental') THEN false END AS changed_flag FROM ev GROUP BY ALL),
d AS (SELECT run_id, document_id, document_title AS title, stage, status, reason_code, message, changed_flag, raw_text_length, transformed_text_length, m.chunk_count, warning_flags,
             status IN ('warning', 'error') OR (status = 'skipped' AND NOT coalesce(reason_code = 'unchanged_incremental' OR (reason_code IS NULL AND changed_flag = false), false)) AS is_problematic
      FROM l JOIN m USING (run_id, document_id)) SELECT * FROM d"""


_DRILL = ["run_id", "document_id", "title", "stage", "status", "reason_code", "message", "changed_flag", "raw_text_length", "transformed_text_length", "chunk_count", "warning_flags", "is_problematic"]


@query(_DRILL_SQL)
def audit_drilldown(spark, sf_dir):
    return audit.drilldown(views.events(spark, sf_dir)).select(_DRILL)


@query(_DRILL_SQL + " WHERE is_problematic")
def audit_drilldown_problematic(spark, sf_dir):
    return audit.drilldown(views.events(spark, sf_dir), only_problematic=True).select(_DRILL)


@query(f"WITH {views.EVENTS_SQL} SELECT DISTINCT document_id FROM ev WHERE stage = 'load' AND status = 'ok' AND document_id NOT IN (SELECT document_id FROM ev WHERE stage = 'chunk' AND {_OK})")
def audit_loaded_not_chunked(spark, sf_dir):
    return audit.loaded_not_chunked(views.events(spark, sf_dir))


@query(f"WITH {views.EVENTS_SQL} SELECT id, document_id, stage, reason_code FROM ev WHERE reason_code IN ('no_chunks_created', 'no_text_after_cleanup', 'empty_after_transform') AND document_id IN (SELECT document_id FROM ev WHERE stage = 'transform' AND status = 'ok')")
def audit_ok_but_empty(spark, sf_dir):
    return audit.ok_but_empty(views.events(spark, sf_dir)).select("id", "document_id", "stage", "reason_code")


# ---------------------------------------------------------------- state, dedupe, routing


def _now(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(c("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))


def _before(spark, sf_dir):
    return _now(spark, sf_dir).where("key % 7 <> 0").withColumn("checksum", F.when(c("key") % 5 == 0, "stale").otherwise(c("checksum")))


_STATE_SQL = "n AS (SELECT doc_id AS key, sha256(coalesce(text, '')) AS checksum FROM documents), b AS (SELECT key, CASE WHEN key % 5 = 0 THEN 'stale' ELSE checksum END AS checksum FROM n WHERE key % 7 <> 0), st AS (SELECT n.key, n.checksum, CASE WHEN b.checksum IS NULL THEN 'new' WHEN b.checksum = n.checksum THEN 'unchanged' ELSE 'changed' END AS status FROM n LEFT JOIN b USING (key))"


@query(f"WITH {_STATE_SQL} SELECT * FROM st")
def cdc_status(spark, sf_dir):
    return state.change_status(_now(spark, sf_dir), _before(spark, sf_dir))


@query(f"WITH {_STATE_SQL} SELECT key, checksum FROM b WHERE key NOT IN (SELECT key FROM st WHERE status <> 'unchanged') UNION ALL SELECT key, checksum FROM st WHERE status <> 'unchanged'")
def state_merge(spark, sf_dir):
    changed = state.change_status(_now(spark, sf_dir), _before(spark, sf_dir)).where("status <> 'unchanged'").select("key", "checksum")
    return state.merge_state(_before(spark, sf_dir), changed)


@query(f"WITH {_STATE_SQL} SELECT 'run' AS run_id, count(*) AS seen, count(*) FILTER (status <> 'unchanged') AS processed, count(*) FILTER (status = 'unchanged') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'changed') AS changed FROM st")
def manifest_summary(spark, sf_dir):
    return state.manifest(state.change_status(_now(spark, sf_dir), _before(spark, sf_dir)).withColumn("run_id", F.lit("run")))


@query("SELECT vec_id, 'v2' AS version, len(embedding) AS dims FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'v1', len(embedding) FROM embeddings WHERE vec_id % 3 <> 0")
def index_upsert(spark, sf_dir):
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"))
    v = lambda name: rows.select("vec_id", F.lit(name).alias("version"), "dims")
    return state.upsert(v("v1"), v("v2").where("vec_id % 3 = 0"), "vec_id")


_DEDUPE_SQL = "d AS (SELECT doc_id, hash, first_value(doc_id) OVER (PARTITION BY hash ORDER BY doc_id % 3, doc_id) AS kept_key FROM (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents))"


def _deduped(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return state.dedupe_content(rows, "hash", "doc_id", [(c("doc_id") % 3).alias("priority")])


@query(f"WITH {_DEDUPE_SQL} SELECT * FROM d")
def content_dedupe(spark, sf_dir):
    return _deduped(spark, sf_dir)


@query(f"WITH {_DEDUPE_SQL} SELECT kept_key, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS aliases FROM (SELECT DISTINCT * FROM d WHERE doc_id <> kept_key) GROUP BY kept_key")
def duplicate_aliases(spark, sf_dir):
    return state.aliases(_deduped(spark, sf_dir), "doc_id")


_RULES = [("/de/", "external/de"), ("example.org", "external/org")]


@query("SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'external/de' WHEN contains(url, 'example.org') THEN 'external/org' ELSE 'external/unassigned' END AS target FROM pages")
def domain_mapping(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", state.first_match(c("url"), _RULES, "external/unassigned").alias("target"))


@query("SELECT page_id, CASE WHEN url GLOB 'https://*/de/*' THEN 'a' WHEN url GLOB '*example.[on]*' THEN 'b' WHEN url GLOB '*[13579]' THEN 'c' ELSE 'none' END AS target FROM pages")
def glob_mapping(spark, sf_dir):
    rules = [("https://*/de/*", "a"), ("*example.[on]*", "b"), ("*[13579]", "c")]
    return views.table(spark, sf_dir, "pages").select("page_id", state.first_match(c("url"), rules, "none", kind="glob").alias("target"))


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'published' ELSE 'unmapped' END AS status, '/out/' || CASE WHEN source = 'src0' THEN 'domains/core' WHEN source = 'src1' THEN 'domains/ops' ELSE '_unmapped/confluence/' || coalesce(nullif(trim(source), ''), '_missing_space') END || '/' || doc_id || '.md' AS target FROM documents")
def publish_route(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents")
    value = lambda k: F.when(F.lit(k) == "space_key", F.coalesce("source", F.lit(""))).otherwise("x")
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k in pages.PUBLISH_KEYS]), F.array(*[F.to_json(F.array(value(k))) for k in pages.PUBLISH_KEYS]))
    meta = F.transform_values(meta, lambda k, v: F.regexp_replace(v, r"^\[|\]$", ""))
    staged = rows.select(F.concat(c("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), meta.alias("metadata"), F.lit("").alias("body"), F.lit("now").alias("published_at"))
    routes = spark.createDataFrame([("src0", "domains/core"), ("src1", "domains/ops")], "space string, domain_path string")
    return pages.publish(staged, routes, "/in", "/out").select(F.regexp_replace("rel_path", "[.]md$", "").cast("long").alias("doc_id"), "status", "target")


# ---------------------------------------------------------------- terminology

_TERM = "[A-Z][a-z]{3,}"
_CAND_SQL = f"""m AS (SELECT source, doc_id, text, regexp_extract_all(text, '{_TERM}') AS found, string_split_regex(text, '{_TERM}') AS between FROM documents),
o AS (SELECT source, doc_id, text, unnest(found) AS term, unnest(list_transform(between[1:len(found)], lambda x: length(x))) AS gap, generate_subscripts(found, 1) AS pos FROM m),
e AS (SELECT *, sum(gap + length(term)) OVER (PARTITION BY doc_id ORDER BY pos) AS ends FROM o),
p AS (SELECT source, doc_id, term, pos, CAST(ends AS BIGINT) AS ends, trim(regexp_replace(substring(text, CAST(greatest(ends - length(term) - 40, 0) AS BIGINT) + 1, CAST(ends + 40 - greatest(ends - length(term) - 40, 0) AS BIGINT)), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g')) AS context FROM e),
cand AS (SELECT source, lower(term) AS norm, count(*) AS n, arg_min(term, (doc_id, pos)) AS term, arg_min(context, (doc_id, pos)) AS example_context, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM p WHERE NOT (lower(term) LIKE 'the%') GROUP BY ALL)"""


def _candidates(spark, sf_dir):
    return terminology.candidates(views.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _TERM, exclude=["the*"])


@query(f"WITH {_CAND_SQL} SELECT * FROM cand")
def term_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(f"WITH {_CAND_SQL} SELECT source, norm, CASE WHEN n % 2 = 0 THEN n + 5 ELSE n END AS n, term, example_context, CASE WHEN n % 2 = 0 THEN -1 ELSE first_seen END AS first_seen, last_seen FROM cand")
def candidate_merge(spark, sf_dir):
    """An earlier report of half of the candidates with counts and places of its own, merged with this one."""
    new = _candidates(spark, sf_dir)
    old = new.where("n % 2 = 0").withColumns({"n": F.lit(5).cast("long"), "first_seen": F.lit(-1).cast("long"), "last_seen": F.lit(-1).cast("long")})
    return terminology.merge_report(old, new)


@query(f"WITH {_CAND_SQL} SELECT source, norm, n, k.term_id IS NOT NULL AS known, CASE WHEN k.term_id IS NOT NULL THEN 'add_alias' WHEN n >= 3 THEN 'new_term' ELSE 'needs_review' END AS action, CASE WHEN k.term_id IS NOT NULL THEN 'done' ELSE 'open' END AS state FROM cand LEFT JOIN (VALUES ('anre', 't1'), ('orin', 't2')) k(norm, term_id) USING (norm)")
def candidate_review(spark, sf_dir):
    known = spark.createDataFrame([("anre", "t1"), ("orin", "t2")], "norm string, term_id string")
    return terminology.review(_candidates(spark, sf_dir), known).select("source", "norm", "n", "known", "action", "state")


# ---------------------------------------------------------------- text functions


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(url), '[^a-z0-9äöüß\-\s]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug,
coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '[\s_-]+', ' ', 'g')), ''), 'untitled') AS title, CASE WHEN page_id % 60 = 0 THEN '' ELSE '' END || array_to_string(list_filter([
CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || 'm' END, CASE WHEN s % 60 > 0 OR s = 0 THEN (s % 60) || 's' END], lambda x: x IS NOT NULL), ' ') AS duration
FROM (SELECT *, page_id * 977 AS s FROM pages)""")
def text_names(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages")
    return rows.select("page_id", tx.slug(c("url")).alias("slug"), tx.title_from_name(F.regexp_extract("url", "[^/]*$", 0)).alias("title"), tx.duration(c("page_id") * 977).alias("duration"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(lower(coalesce(text, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '/', ' '), '[^a-z0-9\s_-]', '', 'g'), '[_-]', ' ', 'g'), '~', ''), '\s+', ' ', 'g')) AS property_key FROM documents""")
def property_normalise(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.property_key(F.coalesce("text", F.lit(""))).alias("property_key"))


# ---------------------------------------------------------------- markup, terms in texts, front matter, housekeeping


@query()
def html_to_markdown(spark, sf_dir):
    out = markup.render_pages(views.table(spark, sf_dir, "pages"), "html", "url")
    return out.select("page_id", F.sha2("markdown", 256).alias("markdown_hash"), F.length("markdown").alias("n_chars"), F.size("tables").alias("n_tables"), "n_tasks", "error")


_TERMS = [
    terminology.Term("t1", "and", ("der",), "a joining word", priority=1, related=("t2",)), terminology.Term("t2", "that", (), "a pointing word", priority=2, related=("t1", "gone")),
    terminology.Term("t3", "the", (), "an article", annotate="never", block="exclude"), terminology.Term("t4", "for", (), "a person", term_class="person", applies_to=("src1", "src2")),
]
_MODES = [("src0", "annotate_and_block", True), ("src1", "block_only", None), ("src2", "annotate_and_block", False), ("src3", "off", True)]


def _word(form: str) -> str:
    """First match of a whole word as a pattern without lookarounds."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({form})($|[^\\p{{L}}\\p{{N}}_])"


def _at(form: str) -> str:
    """0-based place of a word's first match, null for none, in DuckDB."""
    return f"CASE WHEN regexp_matches(t, '{_word(form)}') THEN length(regexp_extract(t, '(?is)^(.*?{_word(form)[4:]})', 1)) - length(regexp_extract(t, '{_word(form)}', 3)) - {len(form)} END"


@query(f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CASE source WHEN 'src0' THEN 'annotate_and_block' WHEN 'src1' THEN 'block_only' WHEN 'src2' THEN 'annotate_and_block' ELSE 'off' END AS mode FROM documents),
p AS (SELECT *, least({_at('and')}, {_at('der')}) AS a1, {_at('that')} AS a2, {_at('the')} AS a3, CASE WHEN source IN ('src1', 'src2') THEN {_at('for')} END AS a4 FROM d WHERE mode <> 'off'),
q AS (SELECT *, CASE WHEN a1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END AS named, CASE WHEN a4 IS NULL THEN 0 ELSE 1 END AS person FROM p)
SELECT doc_id, CAST(coalesce(least(a1, a2, a3, a4), -1) AS INTEGER) AS first_match, CAST(CASE WHEN mode = 'annotate_and_block' THEN named ELSE 0 END AS INTEGER) AS annotations, named + person >= 2 AS block_added FROM q
UNION ALL SELECT doc_id, -1, 0, false FROM d WHERE mode = 'off'""")
def term_annotation(spark, sf_dir):
    """First match, annotations and block of every document by its source's mode."""
    ensure_package(spark)
    modes = spark.createDataFrame(_MODES, "source string, mode string, candidates_enabled boolean")
    return terminology.apply(views.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), _TERMS, modes).select("doc_id", "first_match", "annotations", "block_added")


@query(r"""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '(?i)(^|[^\p{L}\p{N}_])(that)($|[^\p{L}\p{N}_])', '\1\2 (a pointing word)\3')) AS annotated FROM documents""")
def term_annotated_text(spark, sf_dir):
    """Texts with one term annotated where it occurs first."""
    ensure_package(spark)
    modes = spark.createDataFrame([("", "annotate_and_block", True)], "source string, mode string, candidates_enabled boolean")
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return terminology.apply(rows, _TERMS[1:2], modes).select("doc_id", F.md5(c("text").cast("binary")).alias("annotated"))


_PADDED = r"regexp_replace(lower(coalesce(text, '')), '([^\p{L}\p{N}_])', ' \1 ', 'g')"


def _times(form: str) -> str:
    return rf"len(regexp_extract_all(' ' || t || ' ', '[^\p{{L}}\p{{N}}_]{form}[^\p{{L}}\p{{N}}_]'))"


@query(f"""WITH p AS (SELECT doc_id, {_PADDED} AS t FROM documents), n AS (SELECT doc_id, 't1' AS term_id, {_times('and')} + {_times('der')} AS n FROM p
UNION ALL SELECT doc_id, 't2', {_times('that')} FROM p) SELECT doc_id, term_id, CAST(n AS BIGINT) AS n FROM n WHERE n > 0""")
def term_matches(spark, sf_dir):
    """Matches of two terms with three forms in every document."""
    found = terminology.occurrences(views.table(spark, sf_dir, "documents").select("doc_id", "text"), _TERMS[:2])
    return found.groupBy("doc_id", "term_id").agg(F.count("*").alias("n"))


@query("SELECT source, mode, mode <> 'off' AND coalesce(e, mode <> 'off') AS candidates, count(*) AS n FROM (SELECT source, CASE source WHEN 'src0' THEN 'annotate_and_block' WHEN 'src1' THEN 'block_only' WHEN 'src2' THEN 'annotate_and_block' ELSE 'off' END AS mode, CASE source WHEN 'src0' THEN true WHEN 'src2' THEN false WHEN 'src3' THEN true END AS e FROM documents) GROUP BY ALL")
def term_source_modes(spark, sf_dir):
    modes = spark.createDataFrame(_MODES, "source string, mode string, candidates_enabled boolean")
    return terminology.source_modes(views.table(spark, sf_dir, "documents").select("source"), modes).groupBy("source", "mode", "candidates").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), p AS (SELECT doc_id, regexp_replace(t, '([^\p{L}\p{N}_])', ' \1 ', 'g') AS t FROM w)
SELECT doc_id, CAST(len(regexp_extract_all(' ' || t || ' ', '[^\p{L}\p{N}_]and[^\p{L}\p{N}_]')) AS INTEGER) AS n FROM p""")
def term_occurrences(spark, sf_dir):
    """Whole-word occurrences of one term in every document, without Python."""
    return views.table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])and(?![\p{L}\p{N}_])")).alias("n"))


_TERM_TABLE_SQL = """t AS (
  SELECT p_partkey AS ord, 't' || (p_partkey % 1900) AS term_id, CASE WHEN p_partkey % 97 = 0 THEN 'pm' WHEN p_partkey % 31 = 0 THEN '' ELSE upper(substring(md5(CAST(p_partkey % 1500 AS VARCHAR)), 1, 3)) END AS canonical,
         CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'l' END AS label, 'd' AS description, ['business', 'system', 'organisation', 'process', 'technology', 'person', 'product'][p_partkey % 7 + 1] AS term_class,
         ['a' || (p_partkey % 1700), CASE WHEN p_partkey % 13 = 0 THEN 'Ci' ELSE 'b' || p_partkey END] AS aliases, CASE p_partkey % 5 WHEN 0 THEN 'never' WHEN 1 THEN 'none' ELSE 'first_occurrence' END AS annotate,
         CASE WHEN p_partkey % 17 = 0 THEN 'eligible' ELSE 'include' END AS block, [CASE WHEN p_partkey % 19 = 0 THEN 'moon' ELSE 'mail' END] AS applies_to, ['t' || (p_partkey % 2000)] AS related FROM part
), own AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY ord DESC) = 1),
al AS (SELECT term_id, ord, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS pos FROM own)"""


def _term_table(spark, sf_dir):
    k = c("p_partkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    text = lambda x: x.cast("string")
    return views.table(spark, sf_dir, "part").select(
        k.alias("ord"), F.concat(F.lit("t"), text(k % 1900)).alias("term_id"), F.when(k % 97 == 0, "pm").when(k % 31 == 0, "").otherwise(F.upper(F.substring(F.md5(text(k % 1500).cast("binary")), 1, 3))).alias("canonical"),
        F.when(k % 11 == 0, "").otherwise("l").alias("label"), F.lit("d").alias("description"), pick([*terminology.CLASSES, "product"], k % 7).alias("term_class"),
        F.array(F.concat(F.lit("a"), text(k % 1700)), F.when(k % 13 == 0, "Ci").otherwise(F.concat(F.lit("b"), text(k)))).alias("aliases"), F.when(k % 5 == 0, "never").when(k % 5 == 1, "none").otherwise("first_occurrence").alias("annotate"),
        F.when(k % 17 == 0, "eligible").otherwise("include").alias("block"), F.array(F.when(k % 19 == 0, "moon").otherwise("mail")).alias("applies_to"), F.array(F.concat(F.lit("t"), text(k % 2000))).alias("related"),
    )


@query(f"""WITH {_TERM_TABLE_SQL}
SELECT 'error' AS severity, 'required_field' AS code, term_id, f AS detail FROM (SELECT term_id, unnest([CASE WHEN canonical = '' THEN 'canonical' END, CASE WHEN label = '' THEN 'label' END]) AS f FROM own) WHERE f IS NOT NULL
UNION ALL SELECT 'error', 'duplicate_canonical', term_id, canonical FROM (SELECT *, row_number() OVER (PARTITION BY lower(canonical) ORDER BY ord) AS rn FROM own) WHERE rn > 1
UNION ALL SELECT 'error', 'invalid_term_class', term_id, term_class FROM own WHERE term_class = 'product'
UNION ALL SELECT 'error', 'invalid_annotate_policy', term_id, annotate FROM own WHERE annotate = 'none'
UNION ALL SELECT 'error', 'invalid_block_policy', term_id, block FROM own WHERE block = 'eligible'
UNION ALL SELECT 'error', 'unknown_source_type', term_id, 'moon' FROM own WHERE applies_to[1] = 'moon'
UNION ALL SELECT 'error', 'duplicate_alias', term_id, a FROM (SELECT *, lag(term_id) OVER (PARTITION BY lower(a) ORDER BY ord, pos) AS before FROM al) WHERE before <> term_id
UNION ALL SELECT 'error', 'invalid_relation_target', term_id, related[1] FROM own WHERE related[1] NOT IN (SELECT term_id FROM own)
UNION ALL SELECT 'error', 'duplicate_id', term_id, term_id FROM (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY ord) AS rn FROM t) WHERE rn > 1
UNION ALL SELECT 'warning', 'person_annotation', term_id, annotate FROM own WHERE term_class = 'person' AND annotate <> 'never'
UNION ALL SELECT 'warning', 'ambiguous_shortform', term_id, canonical FROM own WHERE upper(canonical) IN ('PM', 'CI', 'PO')
UNION ALL SELECT 'warning', 'ambiguous_shortform', term_id, a FROM al WHERE upper(a) IN ('PM', 'CI', 'PO')""")
def term_validation(spark, sf_dir):
    return terminology.validate(_term_table(spark, sf_dir))


@query(f"WITH {_TERM_TABLE_SQL} SELECT count(*) AS terms, CAST(sum(len(aliases)) AS BIGINT) AS aliases, CAST(sum(len(related)) AS BIGINT) AS relations FROM own")
def term_statistics(spark, sf_dir):
    return terminology.statistics(_term_table(spark, sf_dir))


@query("SELECT doc_id, array_to_string(list_filter(['title', 'source_type', 'source_system', 'source_key'], lambda k: k = 'source_key' OR (k = 'title' AND doc_id % 5 = 0)), ',') AS missing FROM documents")
def front_matter_validate(spark, sf_dir):
    title = F.when(c("doc_id") % 5 == 0, "").otherwise("t")
    meta = F.create_map(F.lit("title"), title, F.lit("source_type"), F.lit("wiki"), F.lit("source_system"), F.lit("s"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(frontmatter.missing_fields(meta), ",").alias("missing"))


@query("""SELECT doc_id, '{"source_type": ' || coalesce('"' || nullif(lang, '') || '"', 'null') || ', "tags": ["a", "b"], "title": "T"}' AS meta, sha256(ltrim(coalesce(text, ''), chr(10))) AS body_hash,
CASE WHEN coalesce(lang, '') = '' THEN 'missing: source_type|' ELSE '' END || 'missing: source_system|missing: source_key' AS problems FROM documents""")
def front_matter_parse(spark, sf_dir):
    ensure_package(spark)
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\ntitle: T\ntags: a, b\nsource_type: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n\n"), F.coalesce("text", F.lit(""))).alias("page"))
    return rows.select("doc_id", frontmatter.parse_column(c("page")).alias("p")).select("doc_id", "p.meta", F.sha2("p.body", 256).alias("body_hash"), F.array_join("p.problems", "|").alias("problems"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS category, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT url, length(html) AS size FROM pages WHERE starts_with(url, 'https://')) GROUP BY 1")
def reset_plan(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("category"), c("url").alias("path"), F.length("html").alias("size"))
    return state.deletion_plan(rows, ["https:/"])


@query("SELECT extension, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(rel_path) AS example FROM (SELECT url AS rel_path, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS extension, length(html) AS size FROM pages) GROUP BY extension")
def extension_inventory(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages").select(c("url").alias("rel_path"), F.lower(F.regexp_extract("url", r"\.([^./]*)$", 1)).alias("extension"), F.length("html").alias("size"))
    return readers.inventory(rows)


@query(f"WITH {views.EVENTS_SQL} SELECT date_trunc('day', created_at)::TIMESTAMP AS day, stage, status, count(*) AS n FROM ev GROUP BY ALL")
def audit_daily(spark, sf_dir):
    return ingest.audit_windows(views.events(spark, sf_dir).withColumn("created_at", c("created_at").cast("timestamp"))).withColumn("day", c("day").cast("timestamp_ntz"))


@query("SELECT d.doc_id, 'own' AS a, CASE WHEN l.doc_id IS NOT NULL THEN CAST(l.quality AS VARCHAR) END AS b FROM documents d LEFT JOIN labels l USING (doc_id)")
def document_metadata_join(spark, sf_dir):
    chunks = views.table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("a"), F.lit("own")).alias("metadata"))
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("a"), F.lit("doc"), F.lit("b"), c("quality").cast("string")).alias("metadata"), F.lit("r").alias("source_ref"))
    return readers.with_document_metadata(chunks, labels).select("doc_id", F.element_at("metadata", "a").alias("a"), F.element_at("metadata", "b").alias("b"))


@query(f"WITH {_FINAL_SQL} SELECT query_id, CAST(final_rank AS INTEGER) AS source_number, doc_id, chunk_id, title, nullif(section_header, '') AS section_header, score FROM (SELECT f.*, h.score FROM final f JOIN hybrid h ON f.query_id = h.query_id AND f.chunk_id = h.chunk_id)")
def source_objects(spark, sf_dir):
    return answer.source_objects(_final(spark, sf_dir).withColumn("rank", c("final_rank")))


@query("""WITH p AS (SELECT doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN 'Priorität' WHEN doc_id % 3 = 1 THEN 'Modul/OFT' ELSE 'Other' END AS label, lang AS value FROM documents)
SELECT page, CASE WHEN label = 'Priorität' THEN 'priorität' ELSE 'modul/oft' END AS name, value FROM p WHERE label <> 'Other' AND page % 2 = 0 UNION ALL SELECT page, CASE WHEN label = 'Priorität' THEN 'priorität' ELSE 'modul/oft' END, 'own' FROM p WHERE label <> 'Other' AND page % 2 = 1""")
def property_promote(spark, sf_dir):
    label = F.when(c("doc_id") % 3 == 0, "Priorität").when(c("doc_id") % 3 == 1, "Modul/OFT").otherwise("Other")
    pairs = views.table(spark, sf_dir, "documents").select(c("doc_id").alias("page"), tx.property_key(label).alias("key"), c("lang").alias("value"), F.lit(1).alias("ord"))
    rules = spark.createDataFrame([("prioritaet", "priorität"), ("prio", "priorität"), ("modul oft", "modul/oft")], "alias string, name string")
    name = F.when(c("page") % 3 == 0, "priorität").otherwise("modul/oft")
    existing = pairs.where("page % 2 = 1 AND page % 3 <> 2").select("page", name.alias("name"), F.lit("own").alias("value"))
    return answer.promote(pairs, rules, existing)


@query(r"SELECT page_id, CASE WHEN regexp_matches(title, '(?i)^log\s+\d{4}\b') THEN 'filtered_by_rule' WHEN length(html) < 400 OR length(trim(url)) < 30 AND page_id % 7 > 0 THEN 'too_small_for_chunking' END AS verdict FROM (SELECT page_id, html, url, CASE WHEN page_id % 5 = 0 THEN 'Log 2024 x' ELSE url END AS title FROM pages)")
def page_filters(spark, sf_dir):
    title = F.when(c("page_id") % 5 == 0, "Log 2024 x").otherwise(c("url"))
    return views.table(spark, sf_dir, "pages").select("page_id", pages.verdict(title, c("html"), c("url"), c("page_id") % 7 == 0, raw_minimum=400, final_minimum=30).alias("verdict"))


# ---------------------------------------------------------------- reports over selected runs


_RICH_SQL = views.EVENTS_SQL + """, rich AS (
  SELECT *, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN 'broken{' WHEN id % 5 = 0 THEN '[1]' WHEN id % 3 = 0 THEN '{"changed_flag": ' || CASE id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END || ', "is_dirty": ' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || '}'
              WHEN id % 2 = 0 THEN '{"warning_flags": ["f' || (id % 4) || '", "g"], "content_id": "c' || id || '"}' ELSE '{}' END AS extra_json FROM ev)"""


def _rich(spark, sf_dir):
    """Events whose extra JSON holds flags, nulls, lists and broken text."""
    i = c("id")
    text = lambda x: x.cast("string")
    flag = F.when(i % 4 == 0, "true").when(i % 4 == 1, "false").otherwise("null")
    extra = (
        F.when(i % 11 == 0, None).when(i % 7 == 0, "broken{").when(i % 5 == 0, "[1]").when(i % 3 == 0, F.concat(F.lit('{"changed_flag": '), flag, F.lit(', "is_dirty": '), F.when(i % 2 == 0, "true").otherwise("false"), F.lit("}")))
        .when(i % 2 == 0, F.concat(F.lit('{"warning_flags": ["f'), text(i % 4), F.lit('", "g"], "content_id": "c'), text(i), F.lit('"}'))).otherwise("{}")
    )
    return views.events(spark, sf_dir).withColumn("extra_json", extra)


@query(f"""WITH {_RICH_SQL}, e AS (SELECT *, id % 11 <> 0 AND id % 7 <> 0 AND id % 5 <> 0 AND id % 3 = 0 AS told, id % 11 <> 0 AND id % 7 <> 0 AND id % 5 <> 0 AND id % 3 <> 0 AND id % 2 = 0 AS flagged FROM rich),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_id, document_id ORDER BY created_at DESC, id DESC) = 1),
f AS (SELECT run_id, document_id, string_agg(DISTINCT f, '|' ORDER BY f) AS warning_flags FROM (
        SELECT run_id, document_id, unnest(CASE WHEN flagged THEN ['f' || (id % 4), 'g'] ELSE [] END || CASE WHEN reason_code IN ('unsupported_macro', 'complex_table') THEN [reason_code] ELSE [] END) AS f FROM e) GROUP BY ALL),
m AS (SELECT run_id, document_id, bool_or(told) AS any_told, arg_max(CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END, (created_at, id)) FILTER (told) AS last_told, bool_or(coalesce(reason_code = 'unchanged_incremental', false)) AS same,
             arg_max(CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END, (created_at, id)) FILTER (told) AS is_dirty, arg_max('c' || id, (created_at, id)) FILTER (flagged) AS content_id FROM e GROUP BY ALL),
d AS (SELECT l.*, f.warning_flags AS flags, m.is_dirty, m.content_id, CASE WHEN any_told THEN CASE last_told WHEN 1 THEN true WHEN 0 THEN false END WHEN same THEN false END AS changed_flag FROM l JOIN m USING (run_id, document_id) LEFT JOIN f USING (run_id, document_id))
SELECT run_id, document_id, source_instance AS source_name, changed_flag, is_dirty, coalesce(changed_flag = false, false) AS unchanged_flag, flags AS warning_flags, content_id, CASE WHEN source_type = 'filesystem' THEN document_uri END AS file_path,
       CASE WHEN source_type = 'wiki' THEN document_id END AS page_id, CASE WHEN status IN ('warning', 'error') THEN true WHEN status = 'skipped' THEN NOT (coalesce(reason_code, '') = 'unchanged_incremental' OR (reason_code IS NULL AND coalesce(changed_flag = false, false))) ELSE false END AS is_problematic FROM d""")
def audit_drilldown_extra(spark, sf_dir):
    """The drill-down over events whose extra JSON tells changes and flags."""
    rows = audit.drilldown(_rich(spark, sf_dir), pages="wiki")
    return rows.select("run_id", "document_id", "source_name", "changed_flag", "is_dirty", "unchanged_flag", "warning_flags", "content_id", "file_path", "page_id", "is_problematic")


@query(f"""WITH {_RICH_SQL} SELECT run_id, count(DISTINCT document_id) AS n FROM rich WHERE stage = 'filter' AND status = 'skipped' AND (reason_code = 'unchanged_incremental' OR (reason_code IS NULL AND json_valid(extra_json) AND json_extract_string(extra_json, '$.changed_flag') = 'false')) GROUP BY run_id""")
def audit_unchanged_extra(spark, sf_dir):
    return _rich(spark, sf_dir).where(audit.unchanged(_rich(spark, sf_dir))).groupBy("run_id").agg(F.count_distinct("document_id").alias("n"))


def _runs(spark, sf_dir):
    e = views.events(spark, sf_dir)
    g = e.groupBy("run_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"), F.count("*").alias("total_events"))
    return g.withColumns({"source_type": F.when(F.substring("run_id", -1, 1).cast("int") % 2 == 0, "wiki").otherwise("filesystem"), "source_instance": F.substring("run_id", -1, 1)})


_RUNS_SQL = "runs AS (SELECT run_id, min(created_at) AS started_at, max(created_at) AS finished_at, count(*) AS total_events, CASE WHEN CAST(right(run_id, 1) AS INTEGER) % 2 = 0 THEN 'wiki' ELSE 'filesystem' END AS source_type, right(run_id, 1) AS source_instance FROM ev GROUP BY run_id)"


@query(f"WITH {views.EVENTS_SQL}, {_RUNS_SQL} SELECT stage, status, count(*) AS n FROM ev WHERE run_id IN (SELECT run_id FROM runs WHERE source_type = 'wiki' AND source_instance = '4') GROUP BY ALL")
def audit_selected_runs(spark, sf_dir):
    runs = audit.select_runs(_runs(spark, sf_dir), source_type="wiki", source_instance="4")
    return audit.of_runs(views.events(spark, sf_dir), runs).groupBy("stage", "status").agg(F.count("*").alias("n"))


@query(f"WITH {views.EVENTS_SQL}, {_RUNS_SQL}, {_TYPES_SQL} SELECT run_id, started_at, total_events, run_type, row_number() OVER (ORDER BY started_at DESC, run_id) AS place FROM runs JOIN types USING (run_id)")
def audit_run_overview(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    rows = audit.run_overview(runs, audit.run_types(runs, views.events(spark, sf_dir)))
    return rows.select("run_id", "started_at", "total_events", "run_type", c("place").cast("long"))


@query(f"""WITH {views.EVENTS_SQL}, g AS (SELECT stage, reason_code, count(*) AS n, min((created_at, id)) AS seen_at FROM ev WHERE reason_code IS NOT NULL GROUP BY ALL)
SELECT stage, reason_code, n, row_number() OVER (PARTITION BY stage ORDER BY n DESC, seen_at) AS place FROM g QUALIFY place <= 2""")
def audit_top_reasons_by_stage(spark, sf_dir):
    return audit.top_reasons(views.events(spark, sf_dir), "stage", 2).select("stage", "reason_code", "n", c("place").cast("long"))


@query(f"""WITH {views.EVENTS_SQL}, g AS (SELECT reason_code, count(*) AS n, min((created_at, id)) AS seen_at FROM ev WHERE reason_code IS NOT NULL GROUP BY ALL)
SELECT reason_code, n, row_number() OVER (ORDER BY n DESC, seen_at) AS place FROM g QUALIFY place <= 10""")
def audit_top_reasons(spark, sf_dir):
    return audit.top_reasons(views.events(spark, sf_dir)).select("reason_code", "n", c("place").cast("long"))


@query(f"WITH {views.EVENTS_SQL} SELECT coalesce(nullif(source_instance, ''), 'unknown') AS instance, reason_code, count(*) AS n FROM ev WHERE source_type = 'wiki' AND reason_code IS NOT NULL GROUP BY ALL")
def audit_instance_reasons(spark, sf_dir):
    return audit.instance_reasons(views.events(spark, sf_dir), "wiki")


_DROPS_SQL = f"WITH {_FUNNEL_SQL}, {_RUNS_SQL}, d AS (SELECT funnel.*, -epoch_us(started_at) AS late FROM funnel LEFT JOIN runs USING (run_id))"


@query(f"{_DROPS_SQL} SELECT 'expected' AS kind, arg_min(run_id, (-expected_dropoff, late, run_id)) AS run_id, max(expected_dropoff) AS drop FROM d UNION ALL SELECT 'problematic', arg_min(run_id, (-problematic_dropoff, late, run_id)), max(problematic_dropoff) FROM d")
def audit_largest_first(spark, sf_dir):
    e = views.events(spark, sf_dir)
    f, runs = audit.funnel(e), _runs(spark, sf_dir)
    rows = [audit.largest_drop(f, f"{k}_dropoff", runs).select(F.lit(k).alias("kind"), "run_id", "drop") for k in ("expected", "problematic")]
    return rows[0].unionByName(rows[1])


@query(f"{_DROPS_SQL} SELECT arg_min(run_id, (-expected_dropoff, late, run_id)) AS largest_expected, max(expected_dropoff) AS expected, arg_min(run_id, (-problematic_dropoff, late, run_id)) AS largest_problematic, max(problematic_dropoff) AS problematic FROM d")
def audit_largest_drops(spark, sf_dir):
    """Both largest drops in one row."""
    e = views.events(spark, sf_dir)
    f, runs = audit.funnel(e), _runs(spark, sf_dir)
    one = lambda k: audit.largest_drop(f, f"{k}_dropoff", runs).select(c("run_id").alias(f"largest_{k}"), c("drop").alias(k))
    return one("expected").crossJoin(F.broadcast(one("problematic")))  # one row each


@query(f"WITH {_FUNNEL_SQL} SELECT run_id, format('{{:.1f}}%', 100.0 * chunked_docs / greatest(1, transformed_ok)) AS quote FROM funnel")
def audit_percent(spark, sf_dir):
    f = audit.funnel(views.events(spark, sf_dir))
    return f.select("run_id", audit.percent(c("chunked_docs") / F.greatest(F.lit(1), c("transformed_ok"))).alias("quote"))


@query(f"WITH {views.EVENTS_SQL}, few AS (SELECT * FROM ev WHERE document_id NOT IN (SELECT document_id FROM ev WHERE stage = 'chunk') OR id % 3 > 0) SELECT DISTINCT document_id FROM ev WHERE stage = 'load' AND status = 'ok' AND id % 3 > 0 AND document_id NOT IN (SELECT document_id FROM ev WHERE stage = 'chunk' AND {_OK} AND id % 97 = 0)")
def audit_loaded_few_chunked(spark, sf_dir):
    """Loaded documents without chunks where most chunk events are missing."""
    e = views.events(spark, sf_dir).where("(stage = 'load' AND id % 3 > 0) OR (stage = 'chunk' AND id % 97 = 0)")
    return audit.loaded_not_chunked(e)


# ---------------------------------------------------------------- pages, publishing, scraped sites


@query(r"""SELECT page_id, CASE WHEN regexp_matches(title, '(?i)^log\s+\d{4}\b') THEN 'filtered_by_rule' WHEN length(html) < 300 THEN 'too_small_for_chunking' WHEN length(trim(final)) < 200 AND page_id % 4 <> 0 THEN 'too_small_for_chunking' END AS verdict
FROM (SELECT page_id, html, substring(html, 1, CAST(page_id % 3 * 150 AS INTEGER)) AS final, CASE WHEN page_id % 5 = 0 THEN 'LOG  2024 x' WHEN page_id % 5 = 1 THEN 'log 20245' ELSE url END AS title FROM pages)""")
def page_verdicts(spark, sf_dir):
    title = F.when(c("page_id") % 5 == 0, "LOG  2024 x").when(c("page_id") % 5 == 1, "log 20245").otherwise(c("url"))
    rows = views.table(spark, sf_dir, "pages").withColumn("final", F.substring("html", F.lit(1), (c("page_id") % 3 * 150).cast("int")))
    return rows.select("page_id", pages.verdict(title, c("html"), c("final"), c("page_id") % 4 == 0, 300, 0).alias("verdict"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS space, doc_id % 6 = 0 AS lacks FROM documents)
SELECT doc_id || '.md' AS rel_path, CASE WHEN lacks THEN 'error' WHEN space IN ('src0', 'src1') THEN 'published' ELSE 'unmapped' END AS status, CASE WHEN lacks THEN 'page_id,labels' ELSE '' END AS missing,
CASE WHEN NOT lacks THEN 'out/' || CASE space WHEN 'src0' THEN 'domains/core' WHEN 'src1' THEN 'domains/ops' WHEN '' THEN '_unmapped/confluence/_missing_space' ELSE '_unmapped/confluence/' || space END || '/' || doc_id || '.md' END AS target,
CASE WHEN NOT lacks THEN md5('---' || chr(10) || 'title: "t"' || chr(10) || 'source_type: "w"' || chr(10) || 'space_key: "' || space || '"' || chr(10) || 'source_url: "u"' || chr(10) || 'page_id: "1"' || chr(10) || 'labels: ["x"]' || chr(10)
 || 'published_from: "in/' || doc_id || '.md"' || chr(10) || 'publish_source_root: "in"' || chr(10) || 'publish_target_path: "out/' || CASE space WHEN 'src0' THEN 'domains/core' WHEN 'src1' THEN 'domains/ops' WHEN '' THEN '_unmapped/confluence/_missing_space' ELSE '_unmapped/confluence/' || space END || '/' || doc_id || '.md"' || chr(10)
 || 'content_origin: "confluence"' || chr(10) || 'domain_path: "' || CASE space WHEN 'src0' THEN 'domains/core' WHEN 'src1' THEN 'domains/ops' WHEN '' THEN '_unmapped/confluence/_missing_space' ELSE '_unmapped/confluence/' || space END || '"' || chr(10) || 'published_at: "now"' || chr(10) || '---' || chr(10) || chr(10) || 'body' || chr(10)) END AS content
FROM d""")
def publish_files(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.coalesce("source", F.lit("")), F.lit('"'))
    meta = F.create_map(F.lit("title"), F.lit('"t"'), F.lit("source_type"), F.lit('"w"'), F.lit("space_key"), quoted, F.lit("source_url"), F.lit('"u"'))
    more = F.create_map(F.lit("page_id"), F.lit('"1"'), F.lit("labels"), F.lit('["x"]'))
    rows = views.table(spark, sf_dir, "documents").select(F.concat(c("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.when(c("doc_id") % 6 == 0, meta).otherwise(F.map_concat(meta, more)).alias("metadata"), F.lit(" body ").alias("body"), F.lit("now").alias("published_at"))
    routes = spark.createDataFrame([("src0", "domains/core"), ("src1", "domains/ops")], "space string, domain_path string")
    return pages.publish(rows, routes, "in", "out").withColumn("content", F.md5(c("content").cast("binary")))


@query(r"""WITH r(ord, id, target_subpath, prefix, part, name) AS (VALUES (1, 'r1', 'a', 'https://', '/de/', NULL), (2, 'r2', 'b', NULL, 'example.org', '3'), (3, 'r3', 'c', '', NULL, 'HTML'), (4, 'r4', 'd', 'https://', NULL, NULL))
SELECT page_id, coalesce(rule_id, 'default') AS rule_id, coalesce(target_subpath, 'external/unassigned') AS target_subpath FROM pages LEFT JOIN (SELECT page_id AS k, arg_min(id, ord) AS rule_id, arg_min(target_subpath, ord) AS target_subpath FROM pages, r
WHERE starts_with(url, coalesce(prefix, '')) AND contains(url, coalesce(part, '')) AND contains(lower(regexp_extract(url, '[^/]*$')), lower(coalesce(name, ''))) GROUP BY page_id) ON k = page_id""")
def mapping_rules(spark, sf_dir):
    rules = spark.createDataFrame([(1, "r1", "a", "https://", "/de/", None), (2, "r2", "b", None, "example.org", "3"), (3, "r3", "c", "", None, "HTML"), (4, "r4", "d", "https://", None, None)], "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string")
    return scrape.choose_rule(views.table(spark, sf_dir, "pages").select("page_id", c("url").alias("rel_path")), rules).select("page_id", "rule_id", "target_subpath")


_FILES_SQL = """f AS (SELECT page_id, page_id || '.' || ['csv', 'PDF', 'json', 'html', 'zip', 'exe', 'zip'][page_id % 7 + 1] AS rel_path, page_id % 7 AS k FROM pages)"""


def _scraped(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("csv", "PDF", "json", "html", "zip", "exe", "zip")]), (c("page_id") % 7 + 1).cast("int"))
    return views.table(spark, sf_dir, "pages").select(F.concat(c("page_id").cast("string"), F.lit("."), ext).alias("rel_path"), F.lit(5).alias("modified"), F.concat(F.lit("/r/"), c("page_id").cast("string")).alias("path"))


@query(f"""WITH {_FILES_SQL} SELECT rel_path, CASE WHEN k IN (1, 4, 5, 6) OR page_id % 3 = 0 THEN 'skipped' ELSE 'convert' END AS status, CASE WHEN k = 1 THEN 'unsupported extension: .pdf' WHEN k IN (4, 6) THEN 'unsupported extension: .zip' WHEN k = 5 THEN 'unsupported extension: .exe'
WHEN page_id % 3 = 0 THEN 'changed-only: existing artifacts are newer than source' END AS warning, 'scraping/' || page_id || '.md' AS markdown_path FROM f""")
def scrape_plan(spark, sf_dir):
    """Which files are converted: by extension, and whether both written files are newer."""
    at = views.table(spark, sf_dir, "pages").where("page_id % 3 <> 2").select("page_id", F.when(c("page_id") % 3 == 0, 5).otherwise(4).alias("modified"))
    old = at.select(F.concat(F.lit("scraping/"), c("page_id").cast("string"), F.lit(".md")).alias("rel_path"), F.lit(9).alias("modified")).unionByName(at.select(F.concat(F.lit("scraping/"), c("page_id").cast("string"), F.lit(".meta.json")).alias("rel_path"), "modified"))
    return scrape.plan(_scraped(spark, sf_dir), old).select("rel_path", "status", "warning", "markdown_path")


@query(f"WITH {_FILES_SQL} SELECT CASE WHEN k = 1 THEN '.pdf' WHEN k = 5 THEN '.exe' ELSE '.zip' END AS extension, count(*) AS n FROM f WHERE k IN (1, 4, 5, 6) GROUP BY ALL")
def scrape_unsupported(spark, sf_dir):
    return scrape.unsupported(scrape.plan(_scraped(spark, sf_dir)))


@query(f"WITH {_FILES_SQL}, l AS (SELECT max(rel_path) AS last FROM (SELECT rel_path FROM f WHERE k IN (0, 2, 3) ORDER BY rel_path LIMIT 20)) SELECT rel_path, k IN (0, 2, 3) AS supported FROM f, l WHERE rel_path <= last")
def scrape_limit(spark, sf_dir):
    """The files up to the first 20 supported ones by path (the limit is the feature)."""
    return scrape.plan(_scraped(spark, sf_dir), limit=20).select("rel_path", c("transformer").isNotNull().alias("supported"))


@query(r"""SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'own' END, CASE WHEN page_id % 3 = 1 THEN 'other' END, CASE WHEN page_id % 2 = 0 THEN 'Head line' END, replace(replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '-', ' '), '_', ' ')) AS title FROM pages""")
def title_choice(spark, sf_dir):
    body = F.when(c("page_id") % 2 == 0, "text\n## no\n#  Head line \n# second").otherwise("#none")
    title = convert.title_of(F.when(c("page_id") % 3 == 0, " own ").otherwise(" "), F.when(c("page_id") % 3 == 1, "other"), body, F.regexp_extract("url", "[^/]*$", 0))
    return views.table(spark, sf_dir, "pages").select("page_id", title.alias("title"))


_CITED_SQL = """cited AS (SELECT conv_id, turn // 20 AS part, turn % 20 AS turn, coalesce(role, '') AS role FROM conversations)"""


def _cited(spark, sf_dir):
    """The sources of answers: the turns of all conversations in parts of 20, numbered within a part."""
    rows = views.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.floor(c("turn") / 20).alias("part"), (c("turn") % 20).alias("turn"), F.coalesce("role", F.lit("")).alias("role"))


@query(f"""WITH {_CITED_SQL} SELECT conv_id, part, string_agg('[' || n || '] ' || t, chr(10) ORDER BY n, turn) AS block FROM (SELECT conv_id, part, turn, CASE WHEN turn % 3 = 0 THEN row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) ELSE 20 - turn END AS n,
CASE WHEN turn % 4 = 0 OR role = '' THEN 'doc' || turn ELSE role END || CASE WHEN turn % 2 = 0 THEN ' – s' || turn ELSE '' END AS t FROM cited) GROUP BY conv_id, part""")
def sources_block(spark, sf_dir):
    t = c("turn").cast("string")
    one = F.struct("turn", F.when(c("turn") % 3 == 0, 0).otherwise((20 - c("turn")).cast("int")).alias("source_number"), t.alias("chunk_id"), F.when(c("turn") % 4 == 0, " ").otherwise(c("role")).alias("title"), F.concat(F.lit("doc"), t).alias("doc_id"), F.when(c("turn") % 2 == 0, F.concat(F.lit("s"), t)).alias("section_header"))
    return _cited(spark, sf_dir).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(one)).alias("s")).select("conv_id", "part", retrieval.sources_block(c("s")).alias("block"))


@query(f"""WITH {_CITED_SQL} SELECT conv_id, part, string_agg(k || '=' || n, ',' ORDER BY k) AS cited FROM (SELECT conv_id, part, 'c' || (turn % 4) AS k, arg_max(n, turn) AS n FROM (SELECT conv_id, part, turn, CASE WHEN turn % 3 = 0 THEN row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) ELSE 20 - turn END AS n FROM cited) WHERE turn % 4 > 0 GROUP BY ALL) GROUP BY conv_id, part""")
def citation_numbers(spark, sf_dir):
    chunk = F.when(c("turn") % 4 > 0, F.concat(F.lit("c"), (c("turn") % 4).cast("string")))
    one = F.struct("turn", F.when(c("turn") % 3 == 0, F.lit(None)).otherwise((20 - c("turn")).cast("int")).alias("source_number"), chunk.alias("chunk_id"))
    g = _cited(spark, sf_dir).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(one)).alias("s")).select("conv_id", "part", retrieval.citation_map(c("s")).alias("m")).where(F.size("m") > 0)
    return g.select("conv_id", "part", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("cited"))


# ---------------------------------------------------------------- inventories, vectors, requested properties


@query("SELECT extension, string_agg(rel_path, '|' ORDER BY rel_path) AS examples FROM (SELECT regexp_extract(url, '\\.([^./]*)$', 1) AS extension, url AS rel_path, row_number() OVER (PARTITION BY regexp_extract(url, '\\.([^./]*)$', 1) ORDER BY url) AS n FROM pages) WHERE n <= 3 GROUP BY extension")
def inventory_samples(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"\.([^./]*)$", 1).alias("extension"), c("url").alias("rel_path"))
    return readers.samples(rows).select("extension", F.array_join("examples", "|").alias("examples"))


@query("SELECT count(*) FILTER (page_id % 3 > 0) AS supported, count(*) FILTER (page_id % 5 = 0) AS markdown, round(count(*) FILTER (page_id % 5 = 0) / CAST(count(*) FILTER (page_id % 3 > 0) AS DOUBLE), 4) AS coverage FROM pages")
def inventory_coverage(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages")
    exported = rows.select(F.when(c("page_id") % 3 == 0, "exe").when(c("page_id") % 3 == 1, "pdf").otherwise("csv").alias("extension"))
    return readers.coverage(exported, rows.select(F.when(c("page_id") % 5 == 0, "md").otherwise("json").alias("extension")))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE vec_id % 5 > 3 OR vec_id % 5 = 0")
def vectors_from_json(spark, sf_dir):
    """Vectors kept as JSON text; broken, empty and non-numeric ones are left out."""
    text = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    rows = views.table(spark, sf_dir, "embeddings").select("vec_id", F.when(c("vec_id") % 5 == 1, "[]").when(c("vec_id") % 5 == 2, '[1, "x"]').when(c("vec_id") % 5 == 3, "{broken").otherwise(text).alias("embedding"))
    return readers.parse_vectors(rows).select("vec_id", F.size("embedding").alias("dims"))


@query("SELECT doc_id AS page, 'modul' AS name, lang AS value FROM documents WHERE doc_id % 3 = 1")
def property_promote_requested(spark, sf_dir):
    key = F.when(c("doc_id") % 3 == 0, "prio").when(c("doc_id") % 3 == 1, "modul oft").otherwise("other")
    pairs = views.table(spark, sf_dir, "documents").select(c("doc_id").alias("page"), key.alias("key"), c("lang").alias("value"), F.lit(1).alias("ord")).where("value IS NOT NULL OR doc_id IS NOT NULL")
    rules = spark.createDataFrame([("prioritaet", "prio"), ("prio", "prio"), ("modul", "modul"), ("modul oft", "modul")], "alias string, name string")
    return answer.promote(pairs, rules, requested=["modul"])


from loomlake.plans import page_queries  # noqa: E402, F401  registers its queries
