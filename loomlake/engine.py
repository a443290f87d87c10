"""Entry points: what a user calls to ingest, index, search, ask, transform, publish, map and report.

Every run writes tables below a root, records its events in the audit log and
returns a summary of one row.  Tables are bucketed deltas: a run writes only the
buckets of the keys that it has taken in anew, and its state last, so that a run
that fails leaves nothing half done and is simply repeated.  Listings of inputs
hold no texts; texts are read for new and changed inputs only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.functions import frontmatter
from loomlake.functions import text as tx
from loomlake.operators import answer, audit, chunking, convert, markup, pages, postings, retrieval, scrape, state, terminology, vector_index
from loomlake.operators.audit_log import AuditLog
from loomlake.runtime import ensure_package
from loomlake.sources import config, exports, readers
from loomlake.sources.delta import AppendLog, DeltaTable

c = F.col
#: The key of each table that the engine keeps.
KEYS = {
    "documents": "doc_id", "chunks": "doc_id", "postings": "doc_id", "postings-metadata": "name", "term-candidates": "candidate", "state": "doc_id", "vectors": "chunk_id", "index-metadata": "model", "pages": "key", "pages-state": "key", "issues": "key", "issues-state": "key",
    "documents-files": "key", "documents-files-state": "key", "scraped": "key", "mapped": "target", "site": "rel_path", "published": "rel_path",
}
MANIFEST = "run_id string, pipeline string, mode string, started_at timestamp, finished_at timestamp, seen long, processed long, skipped long, failed long, changed long"
#: Which copy of a file is kept, by the tree that it lies in.
PRIORITY = {"documents": 0, "jira": 1, "confluence": 2, "scraping": 3, "inbox": 4}


@dataclass(frozen=True)
class Settings:
    """Bounds and weights of a run; the defaults are the usual ones."""

    candidates: int = retrieval.CANDIDATES
    final_k: int = retrieval.FINAL
    keyword_weight: float = 0.5
    vector_weight: float = 0.5
    raw_minimum: int = pages.RAW_MINIMUM
    final_minimum: int = pages.FINAL_MINIMUM
    batch: int = 64
    #: Buckets of a table when it is made: as many as make one bucket the work of one task.
    buckets: int = 32
    #: Up to so many changed files are named to the scan, which then opens no others; beyond, it is filtered by a join.
    named_files: int = 1000
    #: Keys after which a transform commits what it has rendered, and the parts into which keys fall at most.
    commit_every: int = 50_000
    most_parts: int = 1000


class Engine:
    """All entry points over one root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, glossary: config.Glossary | None = None, converters: tuple[convert.Converter, ...] = convert.CONVERTERS):
        self.spark, self.root, self.settings, self.glossary = spark, root.rstrip("/"), settings or Settings(), glossary
        self.converters = converters
        self.log = AuditLog(spark, f"{self.root}/audit")
        self._manifests = AppendLog(spark, f"{self.root}/manifests", T.StructType.fromDDL(MANIFEST))
        self.steps: dict[str, int] = {}
        ensure_package(spark)

    # ------------------------------------------------------------ tables

    def _path(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def delta(self, name: str) -> DeltaTable:
        """One of the engine's tables, with its commits."""
        return DeltaTable(self.spark, f"{self.root}/{name}", KEYS[name], self.settings.buckets)

    def table(self, name: str) -> DataFrame | None:
        """The last version of a table; None where there is none."""
        return self.delta(name).read()

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Writes what a run works on (listings, and texts of new and changed inputs), in place of what the run before left."""
        path = f"{self.root}/staging/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _named(self, rows: DataFrame, column: str) -> list | None:
        """The values of a column if there are few, else None."""
        most = self.settings.named_files
        some = [r[0] for r in rows.select(column).limit(most + 1).collect()]
        return some if len(some) <= most else None

    def _run(self, kind: str, source: str | None, full: bool, work: Callable[[str], DataFrame]) -> DataFrame:
        """Records a run around its work, which returns the statuses (run_id, status) of its documents."""
        run, began = f"{kind}-{uuid.uuid4().hex[:12]}", datetime.now(UTC)
        mode = "full" if full else "incremental"
        self.log.record_run(run, kind, "running", began, source_instance=source, mode=mode)
        try:
            statuses = work(run)
            summary = state.manifest(statuses.withColumn("run_id", F.lit(run)))
            n = self.log.count(run)
        except Exception:
            self.log.record_run(run, kind, "failed", began, datetime.now(UTC), source, mode)
            raise
        ended = datetime.now(UTC)
        self.steps.pop(run, None)
        self.log.record_run(run, kind, "finished", began, ended, source, mode, n)
        marks = {"pipeline": F.lit(kind), "mode": F.lit(mode), "started_at": F.lit(began), "finished_at": F.lit(ended)}
        self._manifests.append(summary.withColumns(marks).select(self._manifests.schema.names).coalesce(1), run)
        return summary

    def manifests(self) -> DataFrame:
        """Counters of every finished run."""
        return self._manifests.read()

    def latest_manifests(self) -> DataFrame:
        """Of each pipeline the counters of the run that started last."""
        return scrape.latest(self.manifests())

    def _events(self, rows: DataFrame, run: str, kind: str, stage: str, source: str | None, **columns) -> None:
        given = {"run_id": F.lit(run), "source_type": F.lit(kind), "source_instance": F.lit(source).cast("string"), "stage": F.lit(stage), **columns}
        self.steps[run] = self.steps.get(run, 0) + 1
        self.log.append(rows.select(*[v.alias(k) for k, v in given.items()]), f"{run}/{self.steps[run]}")

    # ------------------------------------------------------------ ingestion and index

    def ingest(self, root: str, full: bool = False, source: str | None = None) -> DataFrame:
        """Takes in the Markdown files of a tree: documents, chunks and state of new and changed ones; others keep theirs."""

        def work(run: str) -> DataFrame:
            listing = readers.markdown_documents(self.spark, root).select("doc_id", "path", "rel_path", "checksum")
            listing = self.stage("ingest-listing", listing)
            state_before = self.table("state")
            state_before = self.spark.createDataFrame([], "doc_id string, checksum string") if state_before is None else state_before
            status = state.change_status(listing, state_before.limit(0) if full else state_before, "doc_id").select("doc_id", "status")
            listing = self.stage("ingest-status", listing.join(status, "doc_id"))
            changed = listing.where("status <> 'unchanged'")
            todo = readers.markdown_documents(self.spark, root, self._named(changed, "path")).join(changed.select("doc_id"), "doc_id", "left_semi").withColumn("parsed", frontmatter.parse_column(c("content")))
            meta = F.from_json("parsed.meta", "map<string,string>")
            title = convert.title_of(F.try_element_at(meta, F.lit("title")), F.lit(None).cast("string"), F.lit(""), c("name"))
            todo = todo.select("doc_id", "rel_path", "checksum", title.alias("title"), c("parsed.body").alias("body"), meta.alias("metadata"), F.length("parsed.body").alias("body_chars"))
            todo = self.stage("ingest-input", todo)
            chunks = chunking.markdown_chunks(todo, key="doc_id", body="body")
            place = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "chunk_start")) - 1
            chunks = chunks.withColumn("chunk_index", place).withColumn("chunk_id", F.format_string("%s-chunk-%04d", "doc_id", "chunk_index"))
            chunks = chunks.join(todo.select("doc_id", "title", c("rel_path").alias("source_ref")), "doc_id")
            gone = self.stage("ingest-gone", state_before.select("doc_id").join(listing.select("doc_id"), "doc_id", "left_anti"))
            done = todo.select("doc_id")
            self.delta("documents").commit(todo, gone)
            self.delta("chunks").commit(chunks, gone.unionByName(done))  # a document that has no chunks any more loses its old ones
            ids = {"document_id": c("doc_id"), "document_uri": c("rel_path"), "document_title": c("title")}
            known = listing.select("doc_id", "status").join(self.table("documents").select("doc_id", "rel_path", "title", "body_chars"), "doc_id")
            self._events(known, run, "filesystem", "load", source, status=F.lit("ok"), input_count=c("body_chars"), **ids)
            self._events(known.where("status = 'unchanged'"), run, "filesystem", "filter", source, status=F.lit("skipped"), reason_code=F.lit("unchanged_incremental"), **ids)
            own = self.delta("chunks")
            n = own.read(buckets=own.changed_buckets(own.version() - 1)).join(done, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
            made = todo.join(n, "doc_id", "left")
            self._events(made, run, "filesystem", "chunk", source, status=F.when(c("n").isNull(), "skipped").otherwise("ok"), reason_code=F.when(c("n").isNull(), "no_chunks_created"), chunk_count=F.coalesce("n", F.lit(0)), **ids)
            # last: until here the run counts as not done, and the next one takes in the same documents again
            self.delta("state").commit(todo.select("doc_id", "checksum"), gone)
            return listing.select("status")

        return self._run("filesystem", source, full, work)

    def build_index(self, embedder: answer.Embedder, rebuild: bool = False) -> DataFrame:
        """Embeds the chunks that have no vector yet or another text than before; vectors of vanished chunks go with ``rebuild``."""
        chunks, vectors = self.delta("chunks"), self.delta("vectors")
        if not chunks.exists():
            raise ValueError("there are no chunks: ingest first")
        before = None if rebuild or not vectors.exists() else self.table("index-metadata")
        seen = -1
        if before is not None:
            row = before.first()
            answer.check_index(row.asDict(), type(embedder).__name__, embedder.name)
            seen = row.chunks_version
        at = chunks.version()
        rows = chunks.read(buckets=chunks.changed_buckets(seen)).select("chunk_id", c("doc_id"), "text", F.sha2("text", 256).alias("text_hash"))
        todo = rows if before is None else rows.join(vectors.read().select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
        size = self.settings.batch

        def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), size):
                    part = batch.iloc[i : i + size]
                    yield part[["chunk_id", "doc_id", "text_hash"]].assign(embedding=embedder.embed(part["text"].fillna("").tolist()))

        new = todo.mapInPandas(embed, "chunk_id string, doc_id string, text_hash string, embedding array<double>")
        vectors.commit(new, whole=before is None)
        dims = vectors.read().agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
        meta = dims.select(F.lit(type(embedder).__name__).alias("provider"), F.lit(embedder.name).alias("model"), F.current_timestamp().alias("created_at"), "dimension", F.lit(at).alias("chunks_version"))
        self.delta("index-metadata").commit(meta, whole=True)
        return self.table("index-metadata")

    def build_postings(self) -> DataFrame:
        """Brings the trigram postings to the chunks' version: only buckets of chunks that changed since are read and written."""
        chunks, rows = self.delta("chunks"), self.delta("postings")
        if not chunks.exists():
            raise ValueError("there are no chunks: ingest first")
        seen = self.table("postings-metadata")
        changed = chunks.changed_buckets(-1 if seen is None else seen.first().chunks_version)
        at, own = chunks.version(), chunks.read(buckets=changed)
        old = rows.read(buckets=changed)
        gone = None if old is None else old.select("doc_id").distinct().join(own.select("doc_id"), "doc_id", "left_anti")
        rows.commit(postings.build(own), gone, order="gram")
        self.delta("postings-metadata").commit(self.spark.range(1).select(F.lit("postings").alias("name"), F.lit(at).alias("chunks_version")), whole=True)
        return self.table("postings-metadata")

    def build_cells(self, cells: int = vector_index.CELLS) -> None:
        """Deals the vectors of the present version to cells, for searches that read only some of them."""
        vectors = self.delta("vectors")
        vector_index.build(vectors.read().drop("text_hash"), f"{self.root}/cells/v{vectors.version()}", cells=cells)

    # ------------------------------------------------------------ questions

    def _searches(self) -> dict[str, retrieval.Search]:
        """How the best chunks and vectors are found: by postings and cells where these are of the present version, else by scans."""
        out: dict[str, retrieval.Search] = {}
        made = self.table("postings-metadata")
        if made is not None and made.first().chunks_version == self.delta("chunks").version():
            rows = self.table("postings")
            out["by_word"] = lambda chunks, questions, k: postings.keyword_search(chunks, rows, questions, k)
        place = f"cells/v{self.delta('vectors').version()}"
        fs, done = self._path(f"{place}/cells/_SUCCESS")
        if fs.exists(done):
            index = vector_index.VectorIndex(self.spark, f"{self.root}/{place}")
            out["by_vector"] = lambda vectors, questions, k: index.search(questions, k).select(*vectors.drop("embedding", "text_hash").columns, "query_id", "score", "rank")
        return out

    def search(self, question: str, embedder: answer.Embedder | None = None, mode: str = "hybrid", k: int = 5) -> DataFrame:
        vector = tuple(embedder.embed([question])[0]) if embedder else ()
        options = {"keyword_weight": self.settings.keyword_weight, "vector_weight": self.settings.vector_weight} if mode == "hybrid" else {}
        return retrieval.search(self.table("chunks"), self.table("vectors"), [retrieval.Question(1, question, vector)], mode, k, **self._searches(), **options)

    def prepare_answer(self, question: str, embedder: answer.Embedder, reranker: answer.Reranker | None = None, builders: answer.Builders | None = None) -> dict:
        """Prompt and sources of a question, without generating."""
        return answer.ask(self.table("chunks"), self.table("vectors"), question, embedder, reranker, None, self.settings.final_k, builders)

    def ask(self, question: str, embedder: answer.Embedder, generator: answer.Generator, reranker: answer.Reranker | None = None, builders: answer.Builders | None = None) -> dict:
        return answer.ask(self.table("chunks"), self.table("vectors"), question, embedder, reranker, generator, self.settings.final_k, builders)

    # ------------------------------------------------------------ transforms

    def _changed(self, rows: DataFrame, name: str, full: bool) -> DataFrame:
        """status of rows (key, checksum) against the table's state; a key whose output is gone counts as changed."""
        before, files = self.table(f"{name}-state"), self.table(name)
        before = self.spark.createDataFrame([], "key string, checksum string") if before is None or full else before
        return state.change_status(rows, before, outputs=None if files is None else files.select("key"))

    def _parts(self, name: str, todo: DataFrame) -> Iterator[DataFrame]:
        """The inputs that a run renders, staged once and given out in parts of about ``commit_every`` keys.

        Each part is committed before the next one is read, so that a run that is ended goes on behind its last part.
        """
        path = f"{self.root}/staging/{name}"
        part = F.pmod(F.xxhash64("key"), F.lit(self.settings.most_parts)).cast("int")
        todo.withColumn("__part", part).write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(T.StructType([*todo.schema.fields, T.StructField("__part", T.IntegerType())])).parquet(path)
        sizes = sorted((r["__part"], r["count"]) for r in rows.groupBy("__part").count().collect())  # most_parts rows at most
        own, held = [], 0
        for number, size in sizes:
            own.append(number)
            held += size
            if held >= self.settings.commit_every or number == sizes[-1][0]:
                yield rows.where(c("__part").isin(own)).drop("__part")
                own, held = [], 0

    def _finish(self, name: str, new: DataFrame, dropped: DataFrame | None, changed: DataFrame) -> None:
        """Commits the files of a part of a run, then (key, checksum) of what it has taken in."""
        self.delta(name).commit(new, None if dropped is None else dropped.select("key"))
        self.delta(f"{name}-state").commit(changed.select("key", "checksum"))

    def _drop(self, name: str, dropped: DataFrame) -> None:
        self.delta(name).commit(gone=dropped.select("key"))

    def _prune(self, name: str, inputs: DataFrame) -> None:
        """Forgets the state of keys that are no inputs any more."""
        before = self.table(f"{name}-state")
        if before is not None:
            self.delta(f"{name}-state").commit(gone=before.select("key").join(inputs.select("key"), "key", "left_anti"))

    def _attached(self, part: DataFrame, key: str, root: str, parent: Column) -> DataFrame:
        """(key, sections, attachment_warnings, attachment_messages, references, artifacts) of the attachments of a part of a run."""
        found = convert.attachment_sections(convert.extract_attachments(part, key, root, self.converters, parent), key)
        return found.select(key, "sections", c("warnings").alias("attachment_warnings"), c("messages").alias("attachment_messages"), "references", "artifacts")

    def _with_terms(self, run: str, kind: str, rows: DataFrame, text: str = "markdown") -> DataFrame:
        """Rows (key, ...) with the glossary's terms annotated and listed as their source's mode says; what looks like a new term is counted.

        Candidates are those of the texts before annotation; a run's counts are added once.
        """
        g = self.glossary
        if g is None or not g.settings.enabled or not g.terms:
            return rows
        modes = self.spark.createDataFrame(list(g.modes), config.MODES)
        rows = rows.withColumn("__source", F.lit(kind))
        own = terminology.source_modes(self.spark.createDataFrame([(kind,)], "source string"), modes).first()
        if own.candidates and g.settings.candidate_detection_enabled:
            pattern = "|".join(f"(?:{p})" for p in g.settings.candidate_patterns)
            found = terminology.candidates(rows, pattern, key="key", text=text, source="__source", exclude=list(g.exclude)).withColumnRenamed("__source", "source")
            before = self.table("term-candidates")
            name = F.concat_ws("|", "source", "norm").alias("candidate")
            if before is not None:
                found = self.stage("term-candidates", found)
                found = terminology.merge_report(before.join(found.select(name), "candidate", "left_semi").select(found.columns), found)
            self.delta("term-candidates").commit(found.select(name, "*"), write_id=run)
        done = terminology.apply(rows, list(g.terms), modes, text, "__source", g.settings.block_min_terms, g.settings.show_aliases_in_block)
        return done.drop("__source", "n_matches", "first_match", "annotations", "block_added")

    def review_candidates(self) -> DataFrame:
        """The counted candidates with what to do about each, by the glossary's terms."""
        rows = self.table("term-candidates")
        if rows is None:
            raise ValueError("there are no candidates: transform pages or issues with a glossary first")
        forms = [(f, t.term_id) for t in (self.glossary.terms if self.glossary else ()) for f in (t.canonical, *t.aliases)]
        known = self.spark.createDataFrame(forms, "form string, term_id string").select(terminology.normalised(c("form")).alias("norm"), "term_id")
        return terminology.review(rows.drop("candidate"), known)

    def validate_terminology(self, folder: str) -> DataFrame:
        """(severity, code, term_id, detail) of what is wrong with the terminology files of a folder."""
        schema = "severity string, code string, term_id string, detail string"
        if problems := config.file_problems(folder):
            return self.spark.createDataFrame(problems, schema)
        return terminology.validate(config.term_frame(self.spark, config.read_yaml(f"{folder}/{config.FILES['terms']}")))

    def transform_pages(self, root: str, spaces: list[str] | None = None, full: bool = False, source: str | None = None) -> DataFrame:
        """Wiki pages of an export as Markdown files; unchanged, ignored and short ones are left out."""

        def work(run: str) -> DataFrame:
            own = self.spark
            rows = exports.wiki_pages(own, root, spaces)
            checksum = F.sha2(F.concat_ws("|", "title", "body", F.coalesce("updated_at", F.lit("")), F.array_join("labels", ",")), 256)
            content_hash = F.sha2(F.concat_ws("|", "title", "body", F.coalesce("updated_at", F.lit("")), F.array_join("labels", ","), pages.attachment_signature(c("attachments"))), 256)
            whole = rows.withColumns({"key": c("page_id"), "checksum": checksum, "content_hash": content_hash, "verdict": pages.verdict(c("title"), c("body"), raw_minimum=self.settings.raw_minimum)})
            rows = self.stage("pages-listing", whole.select("key", "checksum", "title", "source_ref", "verdict", F.length("body").alias("chars")))
            status = self.stage("pages-status", self._changed(rows.where("verdict IS NULL"), "pages", full))
            todo = whole.join(status.where("status <> 'unchanged'").select("key"), "key", "left_semi")
            rules = pages.promotion_rules()
            ids = {"document_id": c("key"), "document_uri": c("source_ref"), "document_title": c("title")}
            ignored = rows.where("verdict IS NOT NULL").select("key", "title", "source_ref", "verdict")
            same = rows.join(status.where("status = 'unchanged'").select("key"), "key", "left_semi")
            self._events(rows, run, "confluence", "load", source, status=F.lit("ok"), input_count=c("chars"), **ids)
            self._events(ignored, run, "confluence", "filter", source, status=F.lit("skipped"), reason_code=c("verdict"), **ids)
            self._events(same, run, "confluence", "filter", source, status=F.lit("skipped"), reason_code=F.lit("unchanged_incremental"), **ids)
            self._drop("pages", ignored)
            done = []
            for n, part in enumerate(self._parts("pages-input", todo)):
                name = F.regexp_extract(pages.page_file(c("space_key"), c("page_id"), c("title")), "[^/]*$", 0)
                rendered = markup.render_pages(part, "body", "source_url", frozenset(x for labels in rules.values() for x in labels), F.regexp_replace(name, r"\.md$", ""), tx.property_key(c("title")).contains(pages.ABOUT_PROPERTIES))
                parent = convert.parents("confluence", c("page_id"), c("title"), c("source_ref"), c("source_url"), name, c("body"))
                attached = self._attached(part, "page_id", root, parent)
                rendered = rendered.withColumns({"task_fields": pages.task_fields(c("markdown")), "markdown": pages.titled(c("title"), c("markdown"))}).join(attached, "page_id", "left")
                rendered = rendered.withColumn("markdown", pages.with_attachments(c("markdown"), c("sections"), c("attachments"), c("references"), linked=True))
                rendered = self._with_terms(f"{run}/{n}", "confluence", rendered)
                warnings = F.concat("warnings", F.coalesce("attachment_warnings", F.array().cast("array<string>")))
                properties = F.map_concat(F.map_filter("properties", lambda k, v: ~F.map_contains_key(c("page_properties"), k)), "page_properties")
                messages = F.concat("messages", F.coalesce("attachment_messages", F.array().cast("array<string>")))
                rendered = rendered.withColumns({"warnings": warnings, "messages": messages, "page_properties": properties})
                final = pages.verdict(c("title"), c("body"), c("markdown"), F.size("tables") > 0, self.settings.raw_minimum, self.settings.final_minimum)
                rendered = self.stage(f"pages-rendered-{n}", rendered.withColumn("verdict", final))
                good = rendered.where("verdict IS NULL AND error IS NULL").withColumn("promoted", pages.promoted(c("page_properties"), rules)).withColumn("promoted", F.struct("promoted.*", "task_fields.*"))
                short = rendered.where("verdict IS NOT NULL AND error IS NULL")
                self._events(short, run, "confluence", "filter", source, status=F.lit("skipped"), reason_code=c("verdict"), **ids)
                how = F.when(c("error").isNotNull(), "error").when(F.size("unsupported") > 0, "warning").otherwise("ok")
                why = F.when(c("error").isNotNull(), "transform_exception").when(F.size("unsupported") > 0, "unsupported_macro")
                self._events(rendered, run, "confluence", "transform", source, status=how, reason_code=why, message=c("error"), input_count=F.length("body"), output_count=F.length("markdown"), extra_json=F.to_json(F.struct(F.lit(True).alias("changed_flag"), F.array_sort(F.array_distinct("warnings")).alias("warning_flags"), c("unsupported").alias("unsupported_macros"))), **ids)
                self._events(good, run, "confluence", "chunk", source, status=F.lit("ok"), input_count=F.length("markdown"), output_count=F.lit(1), chunk_count=F.lit(1), **ids)
                self._finish("pages", pages.page_files(good), short, part)
                done.append(rendered.select("key", c("error").isNotNull().alias("bad"), (c("error").isNull() & c("verdict").isNotNull()).alias("left_out")))
            self._prune("pages", rows.where("verdict IS NULL"))
            ends = reduce(DataFrame.unionByName, done) if done else self.spark.createDataFrame([], "key string, bad boolean, left_out boolean")
            # a page that is left out counts as seen twice, as unchanged and by its first status
            statuses = status.join(ends, "key", "left")
            out = statuses.where("left_out").select(F.lit("unchanged").alias("status")).unionByName(ignored.select(F.lit("unchanged").alias("status")))
            return statuses.select(F.when(c("bad"), "failed").otherwise(c("status")).alias("status")).unionByName(out)

        return self._run("confluence", source, full, work)

    def transform_issues(self, root: str, projects: list[str] | None = None, full: bool = False, source: str | None = None) -> DataFrame:
        """Issues of an export as Markdown files, with their attachments' texts."""

        def work(run: str) -> DataFrame:
            rows = exports.issues(self.spark, root, projects).where("issue_key IS NOT NULL")
            parts = ["issue_key", "summary", "description", F.coalesce("updated_at", F.lit("")), F.array_join("labels", ",")]
            checksum = F.sha2(F.concat_ws("|", *parts, F.array_join(F.array_sort("attachment_paths"), ",")), 256)  # an issue changes with its attachments
            content_hash = F.sha2(F.concat_ws("|", *parts, pages.attachment_signature(c("attachments"))), 256)
            whole = rows.withColumns({"key": c("issue_key"), "checksum": checksum, "content_hash": content_hash})
            rows = self.stage("issues-listing", whole.select("key", "checksum", "summary", "source_ref", F.length("description").alias("chars")))
            status = self.stage("issues-status", self._changed(rows, "issues", full))
            todo = whole.join(status.where("status <> 'unchanged'").select("key"), "key", "left_semi")
            path = pages.page_file(c("project_key"), c("issue_key"), c("summary"))
            ids = {"document_id": c("key"), "document_uri": c("source_ref"), "document_title": c("summary")}
            self._events(rows, run, "jira", "load", source, status=F.lit("ok"), input_count=c("chars"), **ids)
            done = []
            for n, part in enumerate(self._parts("issues-input", todo)):
                name = F.regexp_extract(path, "[^/]*$", 0)
                attached = self._attached(part, "key", root, convert.parents("jira", c("key"), c("summary"), c("source_ref"), c("source_url"), name, c("description")))
                rendered = markup.render_pages(part, "description", "source_url").join(attached, "key", "left")
                text = pages.with_attachments(pages.issue_body(c("markdown")), c("sections"), c("attachments"), c("references"), linked=True, gap="\n\n\n")
                rendered = rendered.withColumns({"markdown": F.when(c("error").isNull(), text), "warnings": F.concat("warnings", F.coalesce("attachment_warnings", F.array().cast("array<string>"))), "messages": F.concat("messages", F.coalesce("attachment_messages", F.array().cast("array<string>")))})
                rendered = self.stage(f"issues-rendered-{n}", self._with_terms(f"{run}/{n}", "jira", rendered))
                good = rendered.where("error IS NULL")
                self._events(rendered, run, "jira", "transform", source, status=F.when(c("error").isNotNull(), "error").otherwise("ok"), message=c("error"), input_count=F.length("description"), output_count=F.length("markdown"), extra_json=F.to_json(F.struct(F.lit(True).alias("changed_flag"))), **ids)
                self._events(good, run, "jira", "chunk", source, status=F.lit("ok"), input_count=F.length("markdown"), output_count=F.lit(1), chunk_count=F.lit(1), **ids)
                files = good.select("key", path.alias("rel_path"), pages.render(pages.issue_metadata(c("references"), c("messages")), c("markdown")).alias("content"))
                self._finish("issues", files.unionByName(pages.artifact_files(good, "key", c("project_key"))), None, part)
                done.append(rendered.select("key", c("error").isNotNull().alias("bad")))
            self._prune("issues", rows)
            ends = reduce(DataFrame.unionByName, done) if done else self.spark.createDataFrame([], "key string, bad boolean")
            return status.join(ends, "key", "left").select(F.when(c("bad"), "failed").otherwise(c("status")).alias("status"))

        return self._run("jira", source, full, work)

    def transform_documents(self, roots: dict[str, str], rules: DataFrame, full: bool = False, source: str | None = None) -> DataFrame:
        """Files of several trees as Markdown, one of equal ones, the others as its aliases."""

        def work(run: str) -> DataFrame:
            rows = convert.union_of_roots(self.spark, roots)
            rows = rows.withColumns({"document_id": F.sha2(F.lower("rel_path"), 256), "hash": F.sha2("content", 256), "extension": convert.extension(c("path"))})
            rank = F.lit(99)
            for origin, place in PRIORITY.items():
                rank = F.when(c("origin") == origin, place).otherwise(rank)
            listed = rows.select(c("path").alias("key"), "hash", "document_id", rank.alias("priority"), "rel_path", "size", "modified", "origin", "extension")
            listed = self.stage("documents-listing", listed)  # paths and hashes: no contents travel
            first = state.dedupe_content(listed, "hash", "key", [c("priority"), c("rel_path")])
            kept = listed.join(first.where("key = kept_key").select("key"), "key", "left_semi")
            alias = first.where("key <> kept_key").join(listed.select("key", "document_id"), "key").groupBy("kept_key").agg(F.array_sort(F.collect_set("document_id")).alias("aliases"))
            kept = kept.withColumn("checksum", F.sha2(F.concat_ws("|", "key", "size", c("modified").cast("double").cast("string")), 256))
            status = self.stage("documents-status", self._changed(kept, "documents-files", full))
            fresh = kept.join(status.where("status <> 'unchanged'").select("key"), "key", "left_semi")
            todo = fresh.select(c("key").alias("path"))
            own = convert.union_of_roots(self.spark, roots, self._named(todo, "path")).withColumns({"document_id": F.sha2(F.lower("rel_path"), 256), "extension": convert.extension(c("path"))})
            files = own.join(todo, "path", "left_semi").select("path", "content", "rel_path", "size", "modified", "origin", "document_id", "extension")
            done = scrape.choose_rule(convert.convert(files, self.converters), rules).withColumnRenamed("target_subpath", "domain")
            done = done.join(alias, done["path"] == alias["kept_key"], "left").drop("kept_key")
            done = done.withColumns({"title": tx.title_from_name(F.regexp_extract("rel_path", "[^/]*$", 0)), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
            done = self.stage("documents-converted", done)
            path = pages.document_file(c("rel_path"), c("document_id"), c("title"))
            good = done.where("success").select(c("path").alias("key"), path.alias("rel_path"), F.concat("domain", F.lit("/"), path).alias("publish_path"), pages.render(pages.document_metadata(), c("markdown")).alias("content"))
            ids = {"document_id": c("document_id"), "document_uri": c("path")}
            self._events(done, run, "documents", "transform", source, status=F.when(c("success"), "ok").otherwise("error"), message=c("error"), output_count=F.length("markdown"), **ids)
            self._finish("documents-files", good, None, fresh)
            self._prune("documents-files", kept)
            bad = done.where("NOT success").select(c("path").alias("key"), F.lit(True).alias("bad"))
            return status.join(bad, "key", "left").select(F.when(c("bad"), "failed").otherwise(c("status")).alias("status"))

        return self._run("documents", source, full, work)

    def transform_scraped(self, root: str, limit: int | None = None, changed_only: bool = True) -> DataFrame:
        """Files of a scraped tree as Markdown with metadata records."""

        def work(run: str) -> DataFrame:
            old = self.table("scraped")
            existing = None if old is None or not changed_only else old.select(c("markdown_path").alias("rel_path"), "modified").unionByName(old.select(c("metadata_path").alias("rel_path"), "modified"))
            planned = scrape.plan(readers.files(self.spark, root), existing, limit, self.converters)
            planned = self.stage("scraped-plan", planned)
            few = self._named(planned.where("status = 'convert'"), "path")
            done = scrape.transform(planned, convert.contents(self.spark, root, only=few).select("path", "content"), run, datetime.now(UTC).isoformat(), self.converters)
            self.delta("scraped").commit(done.withColumns({"modified": F.current_timestamp(), "key": c("rel_path")}))
            return planned.join(self.table("scraped").select("path", c("status").alias("how")), "path", "left").select(F.when(c("status") == "skipped", "unchanged").when(c("how") == "failed", "failed").otherwise("new").alias("status"))

        return self._run("scraping", None, not changed_only, work)

    def map_scraped(self, rules: DataFrame, force: bool = False) -> DataFrame:
        """The domain tree of the scraped files."""
        done, old = self.table("scraped"), self.table("mapped")
        new = scrape.map_to_domains(done, done.where("status = 'transformed'"), rules, datetime.now(UTC).isoformat(), None if old is None or force else old.select("target"))
        self.delta("mapped").commit(new if old is None else new.where("status = 'mapped'"))
        return self.table("mapped")

    def import_site(self, root: str, source_key: str) -> DataFrame:
        """The pages of a crawl with unified front matter."""
        own = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(f"{root.rstrip('/')}/pages", wholetext=True)
        rel = F.regexp_extract("_metadata.file_path", "(?s)^.*?/pages/(.*)$", 1)
        rows = own.select(rel.alias("rel_path"), c("_metadata.file_name").alias("name"), c("value").alias("content"))
        manifest = exports.texts(self.spark, root, "manifest.json").select("value")
        new = scrape.import_pages(rows, manifest, source_key, root.rstrip("/").rpartition("/")[2], datetime.now(UTC).isoformat(timespec="seconds"))
        self.delta("site").commit(new)
        return self.table("site")

    def publish(self, routes: DataFrame, space: str | None = None, unmapped: bool = True, full: bool = False) -> DataFrame:
        """The transformed pages at their places in the domain tree; those published before in the same words are skipped.

        Returns what became of each page (status published, unmapped, error or skipped). Pages with errors are tried again
        next time; what was published of pages that are not asked for now stays.
        """
        staged = self.table("pages").where(c("rel_path").endswith(".md")).select("rel_path", "content", F.sha2("content", 256).alias("checksum"))
        staged = staged.where(F.concat(F.lit("/"), "rel_path").contains(f"/{space}/")) if space else staged
        before = None if full else self.table("published")
        same = self.spark.createDataFrame([], "rel_path string, checksum string, target string") if before is None else before.where("status <> 'error' AND target IS NOT NULL").select("rel_path", "checksum", "target")
        skipped = staged.select("rel_path", "checksum").join(same, ["rel_path", "checksum"])
        staged = staged.join(same, ["rel_path", "checksum"], "left_anti")
        parsed = staged.withColumn("p", frontmatter.parse_column(c("content")))
        # values as JSON: objects and lists are, texts are quoted; the keys that publishing asks for come from the unified ones
        quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
        at = lambda path: quoted(F.coalesce(F.get_json_object("p.meta", path), F.lit("")))
        own = F.transform_values(F.from_json("p.meta", "map<string,string>"), lambda k, v: F.when(v.rlike(r"^\s*[\[{]"), v).otherwise(quoted(v)))
        asked = F.create_map(F.lit("space_key"), at("$.source_meta.space_key"), F.lit("page_id"), at("$.original_id"), F.lit("labels"), F.coalesce(F.get_json_object("p.meta", "$.tags"), F.lit("[]")), F.lit("source_url"), at("$.source_url"))
        own = F.map_concat(own, F.map_filter(asked, lambda k, v: ~F.array_contains(F.json_object_keys("p.meta"), k)))
        rows = parsed.select("rel_path", own.alias("metadata"), c("p.body").alias("body"), F.lit(datetime.now(UTC).isoformat()).alias("published_at"))
        done = pages.publish(rows, routes, f"{self.root}/pages", f"{self.root}/domains", unmapped=unmapped)
        none = F.lit(None).cast("string")
        skipped = skipped.select("rel_path", F.lit("skipped").alias("status"), F.lit("").alias("missing"), "target", none.alias("content"))
        run = self.stage("published", done.unionByName(skipped))
        self.delta("published").commit(run.where("status <> 'skipped'").join(self.table("pages").select("rel_path", F.sha2("content", 256).alias("checksum")), "rel_path"))
        return run

    # ------------------------------------------------------------ reports and housekeeping

    def report(self, **filters: str | None) -> dict[str, DataFrame]:
        return audit.report(self.log.runs(), self.log.events(), **filters)

    def drilldown(self, only_problematic: bool = False, **filters: str | None) -> DataFrame:
        runs = audit.select_runs(self.log.runs(), **filters)
        return audit.in_report_order(audit.drilldown(audit.of_runs(self.log.events(), runs), only_problematic))

    def reset(self, scopes: list[str], dry: bool = True) -> DataFrame:
        """Count and bytes of what lies in some of the engine's tables; removes them unless ``dry``."""
        there = [s for s in scopes if self._path(s)[0].exists(self._path(s)[1])]
        out = None
        for name in there:
            rows = readers.files(self.spark, f"{self.root}/{name}").select(F.lit(name).alias("category"), F.regexp_replace("path", "^file:/*", "/").alias("path"), "size")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], "category string, n long, bytes long")
        plan = state.deletion_plan(out, [f"/{self.root.removeprefix('file:').lstrip('/')}"])
        plan = self.spark.createDataFrame(plan.collect(), plan.schema)  # a row for each scope
        if not dry:
            for name in there:
                fs, place = self._path(name)
                fs.delete(place, True)
        return plan

    def pipeline(self, steps: list[tuple[str, dict]]) -> dict[str, object]:
        """Runs entry points by name in the given order; a failing step ends the run."""
        return {name: getattr(self, name)(**options) for name, options in steps}
