"""Further registered queries: stores, logs, page files, converted files and terms, over adapters of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions import frontmatter
from loomlake.functions import text as tx
from loomlake.operators import answer, convert, images, pages, retrieval, scrape, terminology
from loomlake.operators.audit_log import AuditLog
from loomlake.plans import views
from loomlake.plans.catalog import _RERANK, _STRIP, _hybrid_sql, _reranked, _word, query
from loomlake.runtime import ensure_package, shared_dir
from loomlake.sources import readers
from loomlake.sources.delta import DeltaTable

c = F.col
_COLLAPSE = r"trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x85\xa0]+', ' ', 'g'))"


def _fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/loomlake/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- stores and logs


@query("SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN md5(coalesce(text, '') || 'x') ELSE md5(coalesce(text, '')) END AS digest FROM documents WHERE doc_id % 10 <> 7 OR lang = 'de'")
def delta_store(spark, sf_dir):
    """All documents kept as deltas: inserted, a tenth changed in two runs (one of them sent twice), a tenth removed and some of it put back, then compacted."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("x")).cast("binary")).alias("other"))
    table = DeltaTable(spark, _fresh(spark, "delta"), "doc_id", buckets=8, most_versions=4)
    first = docs.select("doc_id", "source", "digest")
    table.commit(first, write_id="all")
    table.commit(first.where("doc_id % 10 = 3").withColumn("digest", F.lit("half")), write_id="half")
    table.commit(docs.where("doc_id % 10 = 3").select("doc_id", "source", c("other").alias("digest")), write_id="changed")
    table.commit(first.where("doc_id % 10 = 3").withColumn("digest", F.lit("twice")), write_id="changed")
    table.commit(gone=first.where("doc_id % 10 = 7"))
    table.commit(docs.where("doc_id % 10 = 7 AND lang = 'de'").select("doc_id", "source", "digest"))
    return table.read()


@query(f"WITH {views.EVENTS_SQL} SELECT run_id, stage, status, count(*) AS n, count(DISTINCT document_id) AS documents FROM ev GROUP BY ALL")
def audit_repository(spark, sf_dir):
    """All events appended to the log in three steps, each of them sent twice, and read again."""
    log = AuditLog(spark, _fresh(spark, "audit"))
    events = views.events(spark, sf_dir)
    for k in range(3):
        for _ in range(2):
            log.append(events.where(c("id") % 3 == k), f"run/step/{k}")
    return log.events().groupBy("run_id", "stage", "status").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query("SELECT 'd' || doc_id AS doc_id, 'd' || doc_id || '-0' AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE source END AS title, md5(text) AS digest, lang FROM documents WHERE doc_id % 5 <> 0 AND trim(coalesce(text, '')) <> ''")
def chunk_lines(spark, sf_dir):
    """Chunks written as JSON lines, a fifth of them broken, and read again."""
    rows = views.table(spark, sf_dir, "documents")
    own = F.concat(F.lit("d"), c("doc_id").cast("string"))
    line = F.to_json(F.struct(own.alias("doc_id"), F.concat(own, F.lit("-0")).alias("chunk_id"), F.when(c("doc_id") % 3 > 0, c("source")).alias("title"), "text", F.create_map(F.lit("lang"), c("lang")).alias("metadata")))
    path = _fresh(spark, "chunk-lines")
    lines = rows.select(F.when(c("doc_id") % 5 == 0, F.concat(F.lit("{"), own)).otherwise(line).alias("value"))
    lines.write.text(path)
    got = readers.chunk_files(spark, path, "*.txt")
    return got.select("doc_id", "chunk_id", "title", F.md5(c("text").cast("binary")).alias("digest"), c("metadata")["lang"].alias("lang"))


# ---------------------------------------------------------------- texts


@query(f"WITH t AS (SELECT doc_id, {_COLLAPSE.format("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(substring(t, 1, 259)) || '…' END AS preview FROM t")
def text_preview(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.coalesce("text", F.lit(""))).alias("preview"))


@query(r"SELECT doc_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[,;]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), '|'), '') AS parts FROM documents")
def property_lists(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.property_list(F.coalesce("text", F.lit(""))), "|").alias("parts"))


@query(f"""WITH {_hybrid_sql(100)}, r AS (
  SELECT *, CASE WHEN query_id = 3 THEN {_RERANK} / 1000 ELSE {_RERANK} END AS rerank_score, count(*) OVER (PARTITION BY query_id) AS n FROM hybrid WHERE rank <= 100
), s AS (SELECT * REPLACE (CASE WHEN rank % 4 = 0 THEN NULL ELSE rerank_score END AS rerank_score) FROM r),
b AS (SELECT *, floor((0.45::DOUBLE * coalesce(rerank_score, 0) + 0.45::DOUBLE * score + 0.10::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (rank - 1)::DOUBLE / n::DOUBLE) + CASE WHEN rank % 3 = 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS blend_score FROM s WHERE rerank_score IS NOT NULL OR rank <= 21)
SELECT query_id, doc_id, blend_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend_score DESC, rerank_score DESC NULLS LAST, rank, doc_id DESC, chunk_id DESC) AS INTEGER) AS blend_rank FROM b""")
def blend_final(spark, sf_dir):
    """Reranked rows and the first 3 * 7 candidates, a quarter of them not reranked, with the bonus of exact matches."""
    rows = _reranked(spark, sf_dir)
    rows = rows.withColumn("rerank_score", F.when(c("rank") % 4 > 0, c("rerank_score")))
    return retrieval.blend(rows, c("rank") % 3 == 0, 7).select("query_id", "doc_id", "blend_score", "blend_rank")


@query("SELECT vec_id AS doc, CASE WHEN d.doc_id IS NULL THEN CAST(vec_id AS VARCHAR) WHEN trim(coalesce(source, '')) = '' THEN CAST(d.doc_id AS VARCHAR) ELSE source END AS title, md5(text) AS digest FROM embeddings e LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) d ON d.doc_id = e.vec_id")
def vector_hits_with_chunks(spark, sf_dir):
    """Vectors as hits, joined to the chunks that two thirds of the documents have; a hit without one keeps its document's id as title."""
    hits = views.table(spark, sf_dir, "embeddings").select(c("vec_id").alias("doc_id"), c("vec_id").cast("string").alias("chunk_id"))
    chunks = views.table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", c("doc_id").cast("string").alias("chunk_id"), c("source").alias("title"), "text")
    return retrieval.with_chunks(hits, chunks).select(c("chunk_id").cast("long").alias("doc"), "title", F.md5(c("text").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- terms


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(t, '{_word('and')}') OR regexp_matches(t, '{_word('der')}') THEN regexp_replace(t, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+$', '') || chr(10) || chr(10) || '## Terminologie' || chr(10) || '- and: a joining word' || chr(10) || '  - Verwandte Begriffe: that' || chr(10) || '  - Aliase: der' || chr(10) ELSE t END) AS processed FROM d""")
def term_block_text(spark, sf_dir):
    """Texts with the block of one term that occurs, its related term and its alias."""
    ensure_package(spark)
    modes = spark.createDataFrame([("here", "block_only", None)], "source string, mode string, candidates_enabled boolean")
    terms = [terminology.Term("t1", "and", ("der",), "a joining word", related=("t2", "gone")), terminology.Term("t2", "that", (), "a pointing word", applies_to=("elsewhere",))]
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.lit("here").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return terminology.apply(rows, terms, modes, least=1, aliases=True).select("doc_id", F.md5(c("text").cast("binary")).alias("processed"))


# ---------------------------------------------------------------- page files, tasks, attachments


_PAGES_SQL = "p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, CASE WHEN page_id % 2 = 0 THEN 'ABC' ELSE 'Xy' END AS space, 'Page ' || page_id AS title, url, html FROM pages)"


def _page_rows(spark, sf_dir):
    """Pages as rendered pages: each third with a complex table, each fifth with two unsupported macros."""
    rows = views.table(spark, sf_dir, "pages")
    text = "array<string>"
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast(text)
    k = c("page_id")
    properties = F.when(k % 4 == 0, F.create_map(F.lit("Prio"), F.lit("hoch"), F.lit("Owner"), F.lit("Anna"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.select(
        k.cast("string").alias("page_id"), F.when(k % 2 == 0, "ABC").otherwise("Xy").alias("space_key"), F.concat(F.lit("Page "), k.cast("string")).alias("title"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("markdown"),
        c("url").alias("source_url"), c("url").alias("source_ref"), F.lit(None).cast("string").alias("created_at"), F.lit("2024").alias("updated_at"), F.when(k % 3 == 1, "A").alias("author"), strings("l1", "l2").alias("labels"), F.lit("Top").alias("parent_title"),
        strings("Top").alias("ancestors"), strings().alias("warnings"), F.when(k % 5 == 0, strings("m1", "m2")).otherwise(strings()).alias("unsupported"), F.lit("h").alias("content_hash"),
        F.array(F.struct(F.lit("a.csv").alias("name"), F.lit(None).cast("string").alias("local_path"))).alias("attachments"), properties.alias("page_properties"), F.when(k % 3 == 0, F.array(F.struct(F.lit("Zeilen=1").alias("shape"), F.concat(F.lit("row "), k.cast("string")).alias("rows")))).otherwise(F.array().cast("array<struct<shape:string,rows:string>>")).alias("tables"),
    )
    return rows.withColumn("promoted", pages.promoted(c("page_properties"), pages.promotion_rules()))


def _parsed_files(spark, sf_dir):
    return pages.page_files(_page_rows(spark, sf_dir)).select("key", "rel_path", frontmatter.parse_column(c("content")).alias("p"))


@query(f"""WITH {_PAGES_SQL} SELECT id AS key, lower(space) || '/' || id || '__page-' || id || '.md' AS rel_path, title, 'confluence_page' AS kind, lower(space) AS source_key, '["l1", "l2"]' AS tags, CASE WHEN page_id % 4 = 0 THEN 'hoch' END AS priority, md5(coalesce(html, '')) AS body FROM p
UNION ALL SELECT id, lower(space) || '/' || id || '__page-' || id || '__table_01.md', 'Tabelle 01 aus ' || title, 'confluence_table', NULL, NULL, NULL, '# Tabelle aus: ' || title || chr(10) || chr(10) || '{pages.OUTSOURCED}' || chr(10) || 'Erkannte Struktur: Zeilen=1.' || chr(10) || chr(10) || '## Inhalt (konservativ abgeflacht)' || chr(10) || chr(10) || 'row ' || id FROM p WHERE page_id % 3 = 0""")
def page_files(spark, sf_dir):
    """The files of all pages, read back: front matter fields, promoted property and body."""
    at = lambda path: F.get_json_object("p.meta", path)
    tags = F.regexp_replace(at("$.tags"), '","', '", "')
    return _parsed_files(spark, sf_dir).select("key", "rel_path", at("$.title").alias("title"), at("$.doc_type").alias("kind"), at("$.source_key").alias("source_key"), tags.alias("tags"), F.get_json_object("p.meta", "$['priorität']").alias("priority"), F.trim(F.regexp_replace("p.body", r"\n$", "")).alias("body"))


@query("SELECT m AS macro, count(*) AS n FROM (SELECT unnest(['m1', 'm2']) AS m FROM pages WHERE page_id % 5 = 0) GROUP BY m")
def macro_totals(spark, sf_dir):
    return pages.unsupported_macros(pages.page_files(_page_rows(spark, sf_dir)).select("rel_path", "content"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || chr(10) || chr(10) || '## Anhang-Inhalte (extrahiert)' || chr(10) || chr(10) || '### x' ELSE url END || CASE WHEN page_id % 3 > 0 THEN chr(10) || '## Anhänge' || chr(10) || chr(10) || '- a.csv' || chr(10) || '- Anhang' || chr(10) ELSE '' END AS body FROM pages")
def attachment_texts(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages")
    names = F.array(F.struct(F.lit("a.csv").alias("name")), F.struct(F.lit(None).cast("string").alias("name")))
    return rows.select("page_id", pages.with_attachments(c("url"), F.when(c("page_id") % 2 == 0, "### x"), F.when(c("page_id") % 3 > 0, names).otherwise(F.slice(names, 1, 0))).alias("body"))


@query("""SELECT doc_id, md5('# ABC-' || doc_id || ': S' || chr(10) || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN coalesce(lang, '') <> '' THEN '- Status: ' || lang END, CASE WHEN coalesce(source, '') <> '' THEN '- Typ: ' || source END, CASE WHEN doc_id % 3 = 0 THEN '- Reporter: R' END], lambda x: x IS NOT NULL), chr(10)) || CASE WHEN coalesce(lang, '') <> '' OR coalesce(source, '') <> '' OR doc_id % 3 = 0 THEN chr(10) || chr(10) || '## Beschreibung' || chr(10) || chr(10) ELSE '' END END || CASE WHEN coalesce(text, '') = '' THEN '_Keine Beschreibung im Export gefunden._' ELSE text END) AS body FROM documents""")
def issue_bodies(spark, sf_dir):
    """All documents as descriptions of issues, below titles and what is known of each; a quarter with nothing known."""
    known = lambda x: F.when(c("doc_id") % 4 > 0, x)
    rows = views.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.lit("ABC-"), c("doc_id").cast("string")).alias("issue_key"), F.lit("S").alias("summary"), known(c("lang")).alias("status"), known(c("source")).alias("issue_type"),
        F.lit("").alias("priority"), F.lit(None).cast("string").alias("assignee"), known(F.when(c("doc_id") % 3 == 0, "R")).alias("reporter"),
    )
    return rows.select("doc_id", F.md5(pages.issue_body(c("text")).cast("binary")).alias("body"))


@query("""WITH a AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS pos FROM conversations)
SELECT conv_id, md5(coalesce(string_agg('### ' || role || chr(10) || chr(10) || t || chr(10), chr(10) ORDER BY pos) FILTER (turn % 3 > 0), '')) AS sections,
  coalesce(string_agg(CASE WHEN turn % 3 = 0 THEN 'attachment_transform_failed' ELSE 'attachment_transform_warning' END, ',' ORDER BY pos) FILTER (turn % 3 < 2), '') AS warnings,
  md5(coalesce(string_agg(CASE WHEN turn % 3 = 0 THEN 'no' ELSE 'Anhang ''' || role || ''': ' || t END, '|' ORDER BY pos) FILTER (turn % 3 < 2), '')) AS messages,
  count(*) FILTER (turn % 3 = 2) AS n_references, count(DISTINCT role) FILTER (turn % 3 > 0) AS n_artifacts, md5(coalesce(max_by(t, pos) FILTER (turn % 3 > 0 AND role = 'user'), '')) AS last_user FROM a GROUP BY conv_id""")
def attachment_blocks(spark, sf_dir):
    """Turns as attachments of their conversations: a third failed, a third with notes of the converter, a third with references; each kept one writes a file named by its role."""
    rows = views.table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "t")) - 1
    bad, k = c("turn") % 3 == 0, c("turn") % 3
    strings = "array<string>"
    one = F.array(F.struct(c("role").alias("name"), F.lit("text/plain").alias("media_type"), c("t").alias("content")))
    given = rows.select(
        "conv_id", pos.alias("pos"), c("role").alias("name"), F.when(~bad, c("t")).alias("markdown"), F.when(bad, convert.FAILED).alias("code"), F.when(bad, "no").alias("message"),
        F.when(k == 1, F.array("t")).otherwise(F.array().cast(strings)).alias("notes"), F.when(k == 2, F.lit("{}")).alias("reference"), F.when(~bad, one).otherwise(F.slice(one, 1, 0)).alias("artifacts"),
    )
    done = convert.attachment_sections(given, "conv_id")
    hashed = lambda x: F.md5(x.cast("binary"))
    return done.select(
        "conv_id", hashed(c("sections")).alias("sections"), F.array_join("warnings", ",").alias("warnings"), hashed(F.array_join("messages", "|")).alias("messages"),
        F.size("references").cast("long").alias("n_references"), F.size("artifacts").cast("long").alias("n_artifacts"), hashed(F.coalesce(F.get(F.transform(F.filter("artifacts", lambda a: a["name"] == "user"), lambda a: a["content"]), 0), F.lit(""))).alias("last_user"),
    )


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'csv' END AS transformer, page_id % 3 < 2 AND page_id % 5 > 0 AS success, CASE WHEN page_id % 3 = 0 AND page_id % 5 > 0 THEN 'Page ' || page_id || ': ' || length(url) END AS said,
  CASE WHEN page_id % 3 = 0 AND page_id % 5 > 0 THEN page_id || '__image__scan.md' END AS file, CASE WHEN page_id % 3 = 0 AND page_id % 5 > 0 THEN 2 ELSE 0 END AS n_artifacts, CASE WHEN page_id % 3 = 0 AND page_id % 5 = 0 THEN 'image conversion failed: empty' WHEN page_id % 3 = 1 AND page_id % 5 = 0 THEN 'csv conversion failed: empty' END AS error FROM pages""")
def files_in_context(spark, sf_dir):
    """All pages' addresses as attached files of three kinds: images that are told their page, tables and unknown ones; a fifth is broken."""

    def looked_at(data, parent):
        if not data:
            raise ValueError("empty")
        return images.Analysis(f"{parent.title}: {len(data)}")

    def listed(data):
        if not data:
            raise ValueError("empty")
        return data.decode()

    k, text = c("page_id"), c("page_id").cast("string")
    none = F.lit("")
    parent = convert.parents("wiki", text, F.concat(F.lit("Page "), text), none, c("url"), none, none).withField("name", F.lit("scan.png"))
    rows = views.table(spark, sf_dir, "pages").select(k, F.concat(F.lit("scan"), F.when(k % 3 == 0, ".png").when(k % 3 == 1, ".csv").otherwise(".exe")).alias("path"), F.when(k % 5 == 0, "").otherwise(c("url")).cast("binary").alias("content"), parent.alias("parent"))
    done = convert.convert(rows, (images.converter(looked_at), convert.Converter("csv", ("csv",), listed)), "parent")
    at = lambda field: F.get_json_object("reference", f"$.{field}")
    return done.select("page_id", "transformer", "success", at("summary").alias("said"), at("derived_md_file").alias("file"), F.size("artifacts").alias("n_artifacts"), "error")


@query("SELECT suffix, count(*) AS total, count(*) FILTER (code IS NULL) AS extracted, count(*) FILTER (code IS NOT NULL) AS failed FROM (SELECT coalesce(nullif(lower(regexp_extract(url, '[^/.](\\.[^./]*)$', 1)), ''), '<noext>') AS suffix, CASE WHEN page_id % 4 = 0 THEN 'bad' END AS code FROM pages) GROUP BY suffix")
def attachment_totals(spark, sf_dir):
    rows = views.table(spark, sf_dir, "pages").select(convert.suffix(c("url"), F.lit(None).cast("string")).alias("suffix"), F.when(c("page_id") % 4 == 0, "bad").alias("code"))
    return convert.attachment_stats(rows)


@query("SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS open, count(*) FILTER (turn % 2 = 1) AS done, coalesce(array_to_string(list_sort(list_distinct(list('n' || (turn % 4)) FILTER (turn % 2 = 0))), ','), '') AS named FROM conversations GROUP BY conv_id")
def task_totals(spark, sf_dir):
    """Turns as open and completed tasks of one text for each conversation."""
    task = lambda n: F.concat(F.lit("- t"), c("turn").cast("string"), F.lit(".\n  Mentions: n"), (c("turn") % 4).cast("string"), F.lit(".\n"))  # noqa: E731, ARG005
    lines = lambda n: F.array_join(F.array_sort(F.collect_list(F.when(c("turn") % 2 == n, task(n)))), "")
    texts = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("# T\n\n## Open Tasks\n\n"), lines(0), F.lit("\n## Completed Tasks\n\n"), lines(1)).alias("t"))
    n, names = pages.task_counts(c("t"), "Open Tasks")
    m, _ = pages.task_counts(c("t"), "Completed Tasks")
    return texts.select("conv_id", n.cast("long").alias("open"), m.cast("long").alias("done"), F.array_join(F.array_sort(names), ",").alias("named"))


# ---------------------------------------------------------------- converted files


@query("""WITH f AS (SELECT page_id, 'in/p' || page_id || CASE page_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.exe' ELSE '.csv' END AS path, page_id % 4 AS k, url FROM pages),
m AS (SELECT *, CASE k WHEN 0 THEN '| id | url |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || url || ' |' WHEN 3 THEN '' ELSE '' END AS markdown FROM f WHERE k <> 2)
SELECT path, md5(markdown) AS digest, CASE WHEN k = 1 THEN 'failed' ELSE 'transformed' END AS status, CAST(length(markdown) AS INTEGER) AS chars, CASE WHEN k = 0 THEN 3 ELSE 0 END AS lines, CASE WHEN k = 0 AND length(markdown) >= 80 THEN '' WHEN k = 0 THEN 'Markdown output is unusually short' ELSE 'Empty markdown output' END AS warnings FROM m""")
def scrape_records(spark, sf_dir):
    """All pages as files of four kinds (tables, broken JSON, unknown, empty), converted with their metadata records."""
    rows = views.table(spark, sf_dir, "pages")
    k = c("page_id") % 4
    path = F.concat(F.lit("in/p"), c("page_id").cast("string"), F.when(k == 1, ".json").when(k == 2, ".exe").otherwise(".csv"))
    content = F.when(k == 0, F.concat(F.lit("id,url\n"), c("page_id").cast("string"), F.lit(","), c("url"), F.lit("\n"))).when(k == 1, "{").otherwise("")
    files = rows.select(path.alias("path"), content.cast("binary").alias("content"))
    planned = scrape.plan(files.select("path", c("path").alias("rel_path"), F.lit(None).cast("timestamp").alias("modified")))
    done = scrape.transform(planned, files, "run", "now")
    return done.select("path", F.md5(c("markdown").cast("binary")).alias("digest"), "status", c("record.markdown_char_count").alias("chars"), c("record.markdown_line_count").cast("int").alias("lines"), F.array_join("record.warnings", ",").alias("warnings"))


@query("""WITH f AS (SELECT 'p/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.csv' END AS rel, page_id FROM pages)
SELECT rel AS rel_path, CASE WHEN page_id % 3 = 0 THEN 'failed' WHEN page_id % 10 = 1 THEN 'skipped' ELSE 'mapped' END AS status, CASE WHEN page_id % 2 = 0 THEN 'web' ELSE 'default' END AS rule, CASE WHEN page_id % 2 = 0 THEN 'external/web' ELSE 'external/unassigned' END || '/p/' || page_id || '.md' AS target, CAST(page_id AS VARCHAR) AS title FROM f""")
def scrape_mapping(spark, sf_dir):
    """All pages as converted files on their way into the domain tree: a third without text, a tenth there already."""
    k = c("page_id")
    rel = F.concat(F.lit("p/"), k.cast("string"), F.when(k % 2 == 0, ".html").otherwise(".csv"))
    rows = views.table(spark, sf_dir, "pages").select(k, F.concat(F.lit("scraping/"), rel).alias("markdown_path"), F.struct(rel.alias("relative_source_path"), F.regexp_extract(rel, "[^/]*$", 0).alias("file_name")).alias("record"))
    rules = spark.createDataFrame([(1, "web", "external/web", "p/", None, ".HTML"), (2, "late", "x", None, ".html", None)], "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string")
    there = rows.where(k % 10 == 1).select(F.concat(F.when(k % 2 == 0, "external/web").otherwise("external/unassigned"), F.lit("/p/"), k.cast("string"), F.lit(".md")).alias("target"))
    done = scrape.map_to_domains(rows, rows.where(k % 3 > 0), rules, "now", there)
    return done.select("rel_path", "status", c("mapping_rule_id").alias("rule"), "target", "title")


@query(f"SELECT 1 AS query_id, doc_id AS source_number, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN CAST(doc_id AS VARCHAR) ELSE trim(source) END AS title, nullif(trim(coalesce(lang, '')), '') AS section_header, {_STRIP.format("coalesce(lang, '')")} AS lang FROM documents")
def source_objects_of_all(spark, sf_dir):
    """What is shown of each document as a source, with the fallbacks of missing titles and sections."""
    rows = views.table(spark, sf_dir, "documents").select(F.lit(1).alias("query_id"), c("doc_id").alias("rank"), c("doc_id").cast("string").alias("doc_id"), F.lit("c").alias("chunk_id"), c("source").alias("title"), c("lang").alias("section_header"), F.lit(0.5).alias("score"))
    return answer.source_objects(rows).select("query_id", "source_number", "doc_id", "title", "section_header", tx.strip(F.coalesce("section_header", F.lit(""))).alias("lang"))
