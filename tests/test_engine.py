"""Entry points from end to end on small trees, and the operators behind them."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomlake.engine import Engine, Settings
from loomlake.functions import frontmatter
from loomlake.operators import answer, audit, convert, images, pages, retrieval, scrape
from loomlake.operators.audit_log import AuditLog, Event
from loomlake.sources import exports
from loomlake.sources.delta import DeltaTable


@pytest.fixture
def put(tmp_path):
    def write(path, text):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text if isinstance(text, str) else json.dumps(text))
        return str(tmp_path / path.split("/")[0])

    return write


def summary(frame):
    r = frame.first()
    return (r.seen, r.processed, r.skipped, r.failed, r.changed)


# ---------------------------------------------------------------- ingestion, index, questions


class Echo:
    name = "echo"

    def generate(self, prompt):
        return "Cats sit [Source 1]"


def test_ingest_index_ask(spark, tmp_path, put):
    root = put("md/a.md", "---\ntitle: Cats\n---\n# Cats\nThe cat sits on the mat " + "and stays there for a very long time " * 10)
    put("md/b.md", "# Dogs\nDogs run in the park " + "and they bark at each other all day long " * 10)
    put("md/c.md", "# only a heading\n")
    e = Engine(spark, str(tmp_path / "data"))
    assert summary(e.ingest(root)) == (2, 2, 0, 0, 0)
    assert summary(e.ingest(root)) == (2, 0, 2, 0, 0)
    first = {r.chunk_id for r in e.table("chunks").collect()}
    put("md/b.md", "# Dogs\nDogs sleep")
    put("md/d.md", "# Birds\nBirds fly over the house")
    (tmp_path / "md/a.md").rename(tmp_path / "md/z.md")
    assert summary(e.ingest(root)) == (3, 3, 0, 0, 1)
    texts = [r.text for r in e.table("chunks").collect()]
    assert any("sleep" in t for t in texts) and not any("bark" in t for t in texts) and sum("cat sits" in t for t in texts) >= 1
    embedder = answer.HashEmbedder(16)
    meta = e.build_index(embedder).first()
    assert (meta.provider, meta.model, meta.dimension) == ("HashEmbedder", "hash", 16)
    assert e.table("vectors").count() == e.table("chunks").count() and first
    before = e.table("vectors").count()
    e.build_index(embedder)
    assert e.table("vectors").count() == before
    with pytest.raises(ValueError):
        e.build_index(type("Other", (), {"name": "x", "embed": embedder.embed})())
    for mode in ("keyword", "vector", "hybrid"):
        hits = e.search("cat mat", embedder, mode, 2).orderBy("rank").collect()
        assert 0 < len(hits) <= 2 and (mode == "vector" or "cat" in hits[0].text)
    with pytest.raises(ValueError):
        e.search("x", mode="none")
    # postings and cells give the same hits, and are left aside when they are older than what they index
    scans = {mode: [tuple(r[n] for n in ("rank", "chunk_id", "score")) for r in e.search("cat mat", embedder, mode, 2).orderBy("rank").collect()] for mode in ("keyword", "vector", "hybrid")}
    e.build_postings()
    e.build_cells(2)
    assert set(e._searches()) == {"by_word", "by_vector"}
    for mode, want in scans.items():
        assert [tuple(r[n] for n in ("rank", "chunk_id", "score")) for r in e.search("cat mat", embedder, mode, 2).orderBy("rank").collect()] == want
    put("md/d.md", "# Birds\nBirds fly over the mat")
    e.ingest(root)
    assert set(e._searches()) == {"by_vector"} and "mat" in [r.text for r in e.search("the mat", mode="keyword", k=9).collect() if "Birds" in r.text][0]
    e.build_postings()
    e.build_index(embedder)
    assert set(e._searches()) == {"by_word"} and any("Birds" in r.text for r in e.search("fly mat", mode="keyword", k=9).collect())
    prepared = e.prepare_answer("cat mat", embedder, answer.LexicalReranker())
    assert prepared["answer"] is None and "cat sits" in prepared["prompt"]
    assert e.ask("cat mat", embedder, Echo())["answer"] == "Cats sit [1]"
    own = answer.Builders(section=lambda number, title, text, header=None: F.concat(F.lit("#"), number.cast("string"), F.lit(" "), title), prompt=lambda q, context, there: F.concat_ws("|", q, context), sources=lambda rows: answer.source_objects(rows).select("source_number"))
    built = e.prepare_answer("cat mat", embedder, builders=own)
    assert built["prompt"].startswith("cat mat|#1 ") and built["sources"][0] == {"source_number": 1}
    report = audit.render(e.report())
    assert "filesystem" in report and "unchanged_incremental" in report and "Chunk-Quote" in report
    assert "| run_id |" in audit.render(e.report(), markdown=True)
    assert e.drilldown().count() == sum(1 for _ in e.drilldown().collect()) > 0
    sizes = {r.category: r.n for r in e.reset(["vectors", "nothing"]).collect()}
    assert sizes["vectors"] > 0 and e.table("vectors") is not None
    e.reset(["vectors"], dry=False)
    assert e.table("vectors") is None
    assert set(e.pipeline([("build_index", {"embedder": embedder}), ("report", {})])) == {"build_index", "report"}


def files_below(path):
    return {str(f.relative_to(path)): f.stat().st_size for f in path.rglob("*.parquet")}


def test_a_run_writes_only_what_it_took_in(spark, tmp_path, put):
    """One changed document of many: one bucket of each table, no text of another document, and one embedded document."""
    for i in range(60):
        put(f"md/d{i}.md", f"# Title {i}\n" + f"word{i} says something of its own and goes on for a while. " * 8)
    root, data = str(tmp_path / "md"), tmp_path / "data"
    e = Engine(spark, str(data))
    e.ingest(root)

    class Counting(answer.HashEmbedder):
        def embed(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.write("".join("x\n" for _ in texts))
            return super().embed(texts)

    e.build_index(Counting(8))
    tables = ("documents", "chunks", "state", "vectors")
    before = {t: files_below(data / t / "rows") for t in tables}
    put("md/d7.md", "# Title 7\nchanged text that is long enough to be a chunk of its own")
    (tmp_path / "asked").unlink()
    assert summary(e.ingest(root)) == (60, 1, 59, 0, 1)
    e.build_index(Counting(8))
    for t, old in before.items():
        new = {f: n for f, n in files_below(data / t / "rows").items() if f not in old}
        assert len({f.split("/")[1] for f in new}) == 1, t
        assert sum(new.values()) < sum(old.values()) / 8, t
    assert (tmp_path / "asked").read_text().count("x") == 1
    assert spark.read.parquet(str(data / "staging/ingest-input")).count() == 1
    (tmp_path / "md/d9.md").unlink()
    e.ingest(root)
    assert e.table("documents").count() == 59 and e.table("chunks").where("text LIKE '%Title 9%'").count() == 0


@pytest.mark.parametrize("broken", ["documents", "chunks", "events", "state"])
def test_a_run_that_fails_at_any_step_is_repeated(spark, tmp_path, put, monkeypatch, broken):
    put("md/a.md", "# A\nfirst text of the document a")
    put("md/b.md", "# B\nfirst text of the document b")
    root = str(tmp_path / "md")
    e = Engine(spark, str(tmp_path / "data"))
    e.ingest(root)
    put("md/a.md", "# A\nsecond text of the document a")
    (tmp_path / "md/b.md").unlink()

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if broken == "events":
            m.setattr(AuditLog, "append", fail)
        else:
            m.setattr(DeltaTable, "commit", lambda self, *a, own=DeltaTable.commit, **k: fail() if self.root.endswith("/" + broken) else own(self, *a, **k))
        with pytest.raises(Exception, match="lost"):
            e.ingest(root)
    assert summary(e.ingest(root)) == (1, 1, 0, 0, 1) and summary(e.ingest(root)) == (1, 0, 1, 0, 0)
    assert [r.text for r in e.table("chunks").collect()] == ["# A\nsecond text of the document a"]
    done = e.log.runs().where("status = 'finished'").select("run_id")
    loads = e.log.events().where("stage = 'load'").join(done, "run_id").groupBy("run_id").count().collect()
    assert sorted(r["count"] for r in loads) == [1, 1, 2]


def test_a_failing_run_is_recorded(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "data"))
    with pytest.raises(Exception):
        e.transform_scraped(str(tmp_path / "missing"))
    assert [r.status for r in e.log.runs().collect()] == ["failed"]


def test_a_vector_hit_without_its_chunk_stays(spark):
    hits = spark.createDataFrame([(1, 1, "a", "a-0", 0.5), (1, 2, "b", "gone", 0.4)], "query_id int, rank int, doc_id string, chunk_id string, score double")
    chunks = spark.createDataFrame([("a", "a-0", "text", " ")], "doc_id string, chunk_id string, text string, title string")
    rows = {r.chunk_id: r for r in retrieval.with_chunks(hits, chunks).collect()}
    assert rows["gone"].title == "b" and rows["gone"].text is None and rows["a-0"].title == "a"


def test_only_the_first_candidates_join_the_reranked(spark):
    rows = spark.createDataFrame([(1, i, str(i), str(i), 1.0 / i, 0.9 if i == 9 else None, None) for i in range(1, 11)], "query_id int, rank int, doc_id string, chunk_id string, score double, rerank_score double, rerank_rank int")
    got = retrieval.blend(rows, F.lit(False), 2).orderBy("blend_rank").collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5, 6, 9]
    assert got[0].rank == 1 and got[0].blend_score == pytest.approx(0.45 + 0.1)


def test_formatted_answers(spark):
    sources = [(0, "c1", "T", "d", "S"), (7, "c2", "", "d2", None), (None, "c1", None, None, " "), (-1, "", "last", "", "")]
    frame = spark.createDataFrame([(sources, "said [source 7]"), ([], None)], "s array<struct<source_number:int,chunk_id:string,title:string,doc_id:string,section_header:string>>, a string")
    got = [r[0] for r in frame.select(retrieval.formatted_answer(F.col("a"), F.col("s"))).collect()]
    assert got[0] == "ANSWER\n\nsaid [7]\n\nSources\n[1] T – S\n[3] Unbekannte Quelle\n[4] last\n[7] d2"
    assert got[1] == "ANSWER\n\nKeine Antwort generiert.\n\nSources\nkeine"
    assert frame.select(retrieval.citation_map(F.col("s")).alias("m")).first().m == {"c2": 7, "c1": 3}


# ---------------------------------------------------------------- audit log


def test_audit_log(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"), jsonl=True)
    assert log.events().count() == 0 and log.runs().count() == 0
    with log.stage(Event("r1", "wiki", "load", document_id="d1")) as event:
        event.input_count = 5
    with pytest.raises(ValueError), log.stage(Event("r1", "wiki", "transform", document_id="d1", extra={"changed_flag": True})):
        raise ValueError("broken page")
    with log.stage(Event("r1", "wiki", "filter", document_id="d2")) as event:
        event.set("skipped", "unchanged_incremental")
    log.flush()
    for _ in range(2):  # a step that is repeated leaves its events once
        log.append(spark.createDataFrame([("r2", "d3", "chunk", "ok")], "run_id string, document_id string, stage string, status string"), "r2/chunk/1")
    rows = {(r.document_id, r.stage): r for r in log.events().collect()}
    assert rows[("d1", "load")].status == "ok" and rows[("d1", "load")].input_count == 5 and rows[("d1", "load")].duration_ms >= 0
    assert (rows[("d1", "transform")].status, rows[("d1", "transform")].reason_code, rows[("d1", "transform")].message) == ("error", "unknown_exception", "broken page")
    assert json.loads(rows[("d1", "transform")].extra_json) == {"changed_flag": True} and rows[("d2", "filter")].reason_code == "unchanged_incremental"
    assert log.count("r1") == 3 and log.count("r2") == 1
    assert spark.read.json(str(tmp_path / "log/jsonl")).count() == 4
    at = datetime(2024, 5, 1, tzinfo=UTC)
    log.record_run("r1", "wiki", "running", at, mode="full")
    log.record_run("r1", "other", "finished", datetime(2025, 1, 1, tzinfo=UTC), at, "inst", "incremental", 3)
    run = log.runs().collect()
    assert [(r.run_id, r.source_type, r.status, r.source_instance, r.mode, r.total_events) for r in run] == [("r1", "wiki", "finished", "inst", "incremental", 3)]
    assert audit.select_runs(log.runs(), day="2024-05-01").count() == 1 and audit.select_runs(log.runs(), day="2024-05-02").count() == 0
    audit.export(audit.problem_documents(log.events()), str(tmp_path / "out.csv"))
    assert {r.document_id for r in spark.read.option("header", True).csv(str(tmp_path / "out.csv")).collect()} == {"d1", "d2"}


# ---------------------------------------------------------------- exports, pages, publishing


def wiki(put):
    put("wiki/i/spaces/ABC/by-id/1/metadata.json", {"id": "1", "title": "My Page", "space": {"key": "ABC"}, "labels": ["a", {"name": "b"}], "ancestors": ["Top", {"title": "Mid"}], "attachments": ["x.csv", {"title": "gone.pdf"}, {"name": "bad.json"}, {"name": "t.zip"}]})
    put("wiki/i/spaces/ABC/by-id/1/content.storage.xml", "<h1>Head</h1><p>" + "words of the page " * 20 + '</p><table><tr><th>Prio</th><td>high</td></tr><tr><th>Owner</th><td>Anna</td></tr></table><table>' + "<tr><td>1</td><td>2</td><td>3</td></tr>" * 16 + '</table><ac:structured-macro ac:name="mystery"></ac:structured-macro>')
    put("wiki/i/spaces/ABC/by-id/1/attachments/x.csv", "a,b\n1,2|3\n")
    put("wiki/i/spaces/ABC/by-id/1/attachments/bad.json", "{")
    put("wiki/i/spaces/ABC/by-id/1/attachments/t.zip", "x")
    put("wiki/i/spaces/XY/by-id/9/2/metadata.json", {"title": "LOG 2024 entry", "spaceKey": "XY", "body": {"storage": {"value": "<p>" + "log " * 200 + "</p>"}}})
    put("wiki/i/spaces/XY/by-id/3/metadata.json", {"id": 3, "title": "Short", "space_key": "XY", "body": "<p>short</p>"})
    put("wiki/i/spaces/XY/by-id/4/metadata.json", "broken")
    return put("wiki/i/spaces/XY/elsewhere/5/metadata.json", {"id": "5"})


def test_wiki_export(spark, put):
    root = wiki(put)
    rows = {r.page_id: r for r in exports.wiki_pages(spark, root).collect()}
    assert set(rows) == {"1", "2", "3"}
    one = rows["1"]
    assert (one.space_key, one.labels, one.ancestors, one.parent_title) == ("ABC", ["a", "b"], ["Top", "Mid"], "Mid")
    assert [(a.name, a.local_path is not None) for a in one.attachments] == [("x.csv", True), ("gone.pdf", False), ("bad.json", True), ("t.zip", True)] and len(one.attachment_paths) == 3
    assert rows["2"].body.startswith("<p>log") and rows["3"].body == "<p>short</p>" and rows["2"].labels == []
    assert [r.page_id for r in exports.wiki_pages(spark, root, ["abc"]).collect()] == ["1"]


def test_issue_export(spark, put):
    put("jira/projects/by-id/1/content.storage.json", {"id": "1", "key": "ABC-123", "fields": {"summary": "S", "project": {"key": "ABC"}, "status": {"name": "Done"}, "description": {"type": "doc"}, "attachment": [{"filename": "spec.csv"}], "components": [{"name": "c1"}, "c2"]}})
    put("jira/projects/by-id/1/metadata.json", {"key": "no"})
    put("jira/projects/attachments/ABC-123/spec.csv", "a,b\n")
    put("jira/projects/attachments/ABC-123/extra.txt", "x")
    put("jira/projects/PRJ/by-key/PRJ-7/metadata.json", {})
    put("jira/projects/PRJ/by-key/PRJ-7/description.txt", "told")
    root = put("jira/projects/PRJ/elsewhere/7/metadata.json", {})
    rows = {r.issue_key: r for r in exports.issues(spark, root).collect()}
    assert set(rows) == {"ABC-123", "PRJ-7"}
    a, b = rows["ABC-123"], rows["PRJ-7"]
    assert (a.project_key, a.status, json.loads(a.description), a.components) == ("ABC", "Done", {"type": "doc"}, ["c1", "c2"])
    assert [x.name for x in a.attachments] == ["spec.csv", "extra.txt"] and len(a.attachment_paths) == 2
    assert (b.summary, b.description, b.project_key) == ("Ohne Titel", "told", "PRJ")


def test_pages_become_files(spark, tmp_path, put):
    root = wiki(put)
    e = Engine(spark, str(tmp_path / "data"))
    assert summary(e.transform_pages(root)) == (3, 1, 2, 0, 0)
    files = e.table("pages").collect()
    files.sort(key=lambda f: f.rel_path)
    assert [f.rel_path for f in files] == ["abc/1__my-page.md", "abc/1__my-page__table_01.md"]
    extra, table = frontmatter.parse(files[1].content)
    assert extra["title"] == "Tabelle 01 aus My Page" and extra["labels"] == ["a", "b"] and not set(pages.PUBLISH_KEYS) - set(extra) and table.startswith("# Tabelle aus: My Page\n\nDiese Tabelle wurde wegen komplexer Struktur aus der Hauptseite ausgelagert.\nErkannte Struktur: Zeilen=16, Spalten=3, nested_table=False, spans=False.\n\n## Inhalt (konservativ abgeflacht)\n\n- Originalzeile 1: Zelle 1=1 | Zelle 2=2 | Zelle 3=3\n") and "[Komplexe Tabelle ausgelagert: 1__my-page__table_01.md]\nHinweis: rows=16," in files[0].content
    meta, body = frontmatter.parse(files[0].content)
    assert meta["priorität"] == "high" and "Prio" not in body and "- **Owner:** Anna" in body and meta["page_properties"] == {"Prio": "high", "Owner": "Anna"}
    assert meta["title"] == "My Page" and meta["source_key"] == "abc" and meta["tags"] == ["a", "b"] and meta["attachments"] == ["x.csv", "gone.pdf", "bad.json", "t.zip"] and meta["unsupported_macros"] == ["mystery"]
    assert set(meta["source_meta"]["transform_warnings"]) >= {"Nicht unterstütztes Makro erkannt: mystery", "Anhang 'gone.pdf' hat keinen auflösbaren lokalen Pfad.", "Anhang 't.zip' hat nicht unterstützte Endung '.zip'."}
    flags = json.loads(e.log.events().where("stage = 'transform'").first().extra_json)["warning_flags"]
    assert flags == sorted({"attachment_missing_local_path", "attachment_transform_failed", "attachment_unsupported_extension", "unsupported_macro"})
    assert "words of the page" in body and "## Anhang-Inhalte (extrahiert)\n\n### x.csv\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |" in body
    assert body.rstrip().endswith("## Anhänge\n\n- x.csv\n- gone.pdf\n- bad.json\n- t.zip")
    assert [tuple(r) for r in pages.unsupported_macros(e.table("pages")).collect()] == [("mystery", 1)] and pages.unsupported_macros(e.table("pages"), "zz").count() == 0
    assert summary(e.transform_pages(root)) == (3, 0, 3, 0, 0)
    put("wiki/i/spaces/ABC/by-id/1/metadata.json", {"id": "1", "title": "Renamed", "space": {"key": "ABC"}})
    assert summary(e.transform_pages(root))[4] == 1
    assert sorted(f.rel_path for f in e.table("pages").collect()) == ["abc/1__renamed.md", "abc/1__renamed__table_01.md"]
    reasons = {r.reason_code for r in e.log.events().collect()}
    assert {"filtered_by_rule", "too_small_for_chunking", "unchanged_incremental", "unsupported_macro"} <= reasons
    routes = spark.createDataFrame([("ABC", "domains/core")], "space string, domain_path string")
    out = e.publish(routes).orderBy("rel_path").collect()
    assert [(r.status, r.missing) for r in out] == [("published", ""), ("published", "")] and out[0].target.endswith("/domains/domains/core/1__renamed.md")
    assert 'content_origin: "confluence"' in out[0].content and "words of the page" in out[0].content
    assert e.publish(routes, space="zz").count() == 0
    # pages published in the same words are skipped, with their places; changed ones are published again and others stay
    before = {r.rel_path: r for r in e.table("published").collect()}
    assert {r.rel_path: (r.status, r.target) for r in e.publish(routes).collect()} == {p: ("skipped", r.target) for p, r in before.items()}
    put("wiki/i/spaces/ABC/by-id/1/metadata.json", {"id": "1", "title": "Renamed", "space": {"key": "ABC"}, "labels": ["fresh"]})
    e.transform_pages(root)
    again = {r.rel_path: r.status for r in e.publish(routes).collect()}
    assert "published" in again.values() and again.keys() == before.keys()
    after = {r.rel_path: r for r in e.table("published").collect()}
    assert all((after[p].content == before[p].content) == (again[p] == "skipped") for p in before)
    assert set(r.status for r in e.publish(routes, full=True).collect()) == {"published"}
    last = {r.pipeline: r for r in e.latest_manifests().collect()}
    assert last["confluence"].processed == 1 and last["confluence"].run_id == e.manifests().orderBy(F.desc("started_at")).first().run_id


def test_issues_become_files(spark, tmp_path, put):
    root = put("jira/projects/by-id/1/metadata.json", {"id": "1", "key": "ABC-1", "fields": {"summary": "A b!", "description": "<p>said</p>", "reporter": {"displayName": "R"}, "labels": ["l"]}})
    e = Engine(spark, str(tmp_path / "data"))
    assert summary(e.transform_issues(root)) == (1, 1, 0, 0, 0) and summary(e.transform_issues(root)) == (1, 0, 1, 0, 0)
    file = e.table("issues").first()
    meta, body = frontmatter.parse(file.content)
    assert file.rel_path == "abc/ABC-1__a-b.md" and meta["title"] == "ABC-1: A b!" and meta["authors"] == ["R"] and body.strip() == "# ABC-1: A b!\n\n- Reporter: R\n\n## Beschreibung\n\nsaid"
    assert meta["image_analysis_status"] == "not_applicable" and meta["image_attachment_count"] == 0
    put("jira/projects/attachments/ABC-1/late.csv", "a\n1\n")  # an issue changes with its attachments, a page does not
    assert summary(e.transform_issues(root))[4] == 1 and "### late.csv" in e.table("issues").first().content
    put("jira/projects/by-id/2/metadata.json", {"id": "2", "key": "ABC-2", "summary": "Bare"})
    e.transform_issues(root)
    bare = e.table("issues").where("key = 'ABC-2'").first().content
    assert frontmatter.parse(bare)[1].strip() == "# ABC-2: Bare\n\n_Keine Beschreibung im Export gefunden._"
    assert {(r.document_id, r.chunk_count) for r in e.log.events().where("stage = 'chunk'").collect()} == {("ABC-1", 1), ("ABC-2", 1)}


def test_images_of_pages_and_issues(spark, tmp_path, put):
    """One image on two pages is analysed for each; its files, links, front matter and warnings; the files go with the image."""

    def looked_at(data, parent):
        if data == b"bad":
            raise ValueError("no image")
        return images.Analysis("" if data == b"blank" else f"{data.decode()} of {parent.title}", "screenshot", "words" if data == b"shot" else "", ("gui",), warnings=("low resolution",) if data == b"shot" else ())

    said = "<p>" + "words of the page " * 20 + "</p><ac:task-list><ac:task><ac:task-status>incomplete</ac:task-status><ac:task-body>write to <ri:user ri:display-name=\"Anna\"/> about the report by 2024-05-01</ac:task-body></ac:task></ac:task-list>"
    shared = str(tmp_path / "wiki/shared/attachments/Screen One.png")
    put("wiki/shared/attachments/Screen One.png", "shot")
    for n in (1, 2):
        items = [{"name": "Screen One.png", "local_path": shared}, {"name": "x.csv", "url": "http://h/x.csv"}, "bad.png", "blank.png"]
        put(f"wiki/by-id/{n}/metadata.json", {"id": str(n), "title": f"P{n}", "space_key": "ABC", "body": said, "attachments": items})
        put(f"wiki/by-id/{n}/attachments/x.csv", "a,b\n1,2\n")
        put(f"wiki/by-id/{n}/attachments/bad.png", "bad")
        root = put(f"wiki/by-id/{n}/attachments/blank.png", "blank")
    e = Engine(spark, str(tmp_path / "data"), converters=(images.converter(looked_at), *convert.CONVERTERS))
    assert summary(e.transform_pages(root)) == (2, 2, 0, 0, 0)
    files = {r.rel_path: r.content for r in e.table("pages").collect()}
    assert sorted(files) == [f"abc/{n}__{x}" for n in (1, 2) for x in ("image__screen-one.json", "image__screen-one.md", f"p{n}.md")]
    for n in (1, 2):
        meta, body = frontmatter.parse(files[f"abc/{n}__p{n}.md"])
        assert body.startswith(f"# P{n}\n\nwords of the page")
        image = f"### Screen One.png\n\n## Kurzbeschreibung\n\nshot of P{n}\n\n## Erkannter Text\n\nwords\n\n### x.csv\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
        links = f"## Abgeleitete Bildanalysen\n\n- [Screen One.png]({n}__image__screen-one.md)\n## Anhänge\n\n- Screen One.png\n- [x.csv](http://h/x.csv)\n- bad.png\n- blank.png"
        assert f"## Anhang-Inhalte (extrahiert)\n\n{image}\n\n{links}" in body
        assert (meta["image_analysis_status"], meta["image_attachment_count"], meta["open_task_count"], meta["open_task_mentions"]) == ("complete", 1, 1, ["Anna"]) and "completed_task_count" not in meta
        ref = meta["image_analysis"][0]
        assert meta["source_meta"]["image_analysis_refs"] == [ref] and "references" not in meta and ref["summary"] == f"shot of P{n}" and ref["mime_type"] == "image/png" and ref["signals"] == ["gui"]
        assert meta["source_meta"]["transform_warnings"] == ["Anhang 'Screen One.png': low resolution", "Anhang 'bad.png' konnte nicht transformiert werden: image conversion failed: no image", "Anhang 'blank.png' lieferte leeres Markdown."]
        assert json.loads(files[f"abc/{n}__image__screen-one.json"])["parent_id"] == str(n)
    # the analyses are no pages: publishing takes Markdown only, and says what their front matter lacks
    routes = spark.createDataFrame([("ABC", "core")], "space string, domain_path string")
    assert {r.rel_path: r.status for r in e.publish(routes).collect()} == {f"abc/{n}__{x}": s for n in (1, 2) for x, s in ((f"p{n}.md", "published"), ("image__screen-one.md", "error"))}
    put("wiki/by-id/2/metadata.json", {"id": "2", "title": "P2", "space_key": "ABC", "body": said})
    assert summary(e.transform_pages(root))[4] == 0, "a page does not change with its attachments"
    put("wiki/by-id/2/metadata.json", {"id": "2", "title": "New", "space_key": "ABC", "body": said})
    e.transform_pages(root)
    assert sorted(r.rel_path for r in e.table("pages").where("key = '2'").collect()) == ["abc/2__new.md"]
    put("jira/projects/by-id/1/metadata.json", {"id": "1", "key": "ABC-125", "summary": "Image", "description": "<p>D.</p>", "attachments": [{"name": "screen.png"}]})
    e.transform_issues(put("jira/projects/attachments/ABC-125/screen.png", "shot"))
    files = {r.rel_path: r.content for r in e.table("issues").collect()}
    assert sorted(files) == ["abc/ABC-125__image.md", "abc/ABC-125__image__screen.json", "abc/ABC-125__image__screen.md"]
    meta, body = frontmatter.parse(files["abc/ABC-125__image.md"])
    assert meta["image_analysis_status"] == "complete" and "words\n\n\n## Abgeleitete Bildanalysen\n\n- [screen.png](ABC-125__image__screen.md)\n## Anhänge\n\n- screen.png" in body


def test_sections_keep_the_last_file_of_a_name(spark):
    file = lambda n, t: {"name": n, "media_type": "text/plain", "content": t}
    rows = spark.createDataFrame(
        [("k", 1, "b", "B", None, None, ["w1", "w2"], '{"attachment_name": "b"}', [file("f", "second")]), ("k", 0, "a", "A", None, None, [], None, [file("f", "first"), file("g", "G")]), ("k", 2, "c", None, convert.EMPTY, "empty", [], None, []), ("n", 0, "a", None, convert.FAILED, "no", [], None, [])],
        "key string, pos int, name string, markdown string, code string, message string, notes array<string>, reference string, artifacts array<struct<name:string,media_type:string,content:string>>",
    )
    got = {r.key: r for r in convert.attachment_sections(rows, "key").collect()}
    k = got["k"]
    assert k.sections == "### a\n\nA\n\n### b\n\nB\n" and k.warnings == [convert.WARNED, convert.WARNED, convert.EMPTY] and k.messages == ["Anhang 'b': w1", "Anhang 'b': w2", "empty"]
    assert {(a.name, a.content) for a in k.artifacts} == {("f", "second"), ("g", "G")} and k.references == ['{"attachment_name": "b"}']
    assert (got["n"].sections, got["n"].references, got["n"].artifacts) == ("", [], [])
    assert convert.attachment_sections(rows.limit(0), "key").count() == 0


def test_attachment_stats(spark, put):
    root = wiki(put)
    rows = convert.extract_attachments(exports.wiki_pages(spark, root), "page_id", root)
    assert {r.suffix: (r.total, r.extracted, r.failed) for r in convert.attachment_stats(rows).collect()} == {".csv": (1, 1, 0), ".pdf": (1, 0, 1), ".json": (1, 0, 1), ".zip": (1, 0, 1)}
    assert {r.code for r in convert.attachment_stats(rows, "code").collect()} == {convert.MISSING_PATH, convert.FAILED, convert.UNSUPPORTED}


def test_tasks_of_rendered_texts(spark):
    text = "# P\n\n## Open Tasks\n\n- one.\n  Mentions: Anna, Bo.\n- two.\n  Mentions: Anna.\n\n## Completed Tasks\n\n- done.\n"
    n, names = pages.task_counts(F.lit(text), "Open Tasks")
    m, nobody = pages.task_counts(F.lit(text), "Completed Tasks")
    r = spark.range(1).select(n.alias("n"), names.alias("names"), m.alias("m"), nobody.alias("nobody")).first()
    assert (r.n, r.names, r.m, r.nobody) == (2, ["Anna", "Bo"], 1, [])


# ---------------------------------------------------------------- converters, documents, scraped sites


@pytest.mark.parametrize("convert_,data,want", [
    (convert.from_csv, b"\xef\xbb\xbfa,b\n1\n", "| a | b |\n| --- | --- |\n| 1 |  |"), (convert.from_csv, b"", ""), (convert.from_json, b'{"a": "\xc3\xa9"}', '```json\n{\n  "a": "é"\n}\n```'),
    (convert.from_xml, b'<r xmlns="u"><x k="1">t</x></r>', "- r\n  - x: k=1 t"), (convert.from_html, b"<h1>T</h1><p>x</p>", "# T\nx"),
])
def test_converters(convert_, data, want):
    assert convert_(data) == want


def test_routing(spark):
    own = (convert.Converter("mine", ("csv", "zip"), bytes.decode), *convert.CONVERTERS)
    rows = spark.createDataFrame([("a/b.CSV",), ("x.zip",), ("x.d/y",), ("x.html",), ("x.pdf",)], "p string")
    got = rows.select(convert.route(convert.extension(F.col("p")), own).alias("r"), convert.can_convert(convert.extension(F.col("p"))).alias("c")).collect()
    assert [(r.r, r.c) for r in got] == [("mine", True), ("mine", False), (None, False), ("html", True), (None, True)]


def test_documents(spark, tmp_path, put):
    put("docs/r/one.csv", "a,b\n1,2\n")
    put("docs/broken.json", "{")
    put("docs/office.pdf", "x")
    put("inbox/copy.csv", "a,b\n1,2\n")
    put("inbox/skip.exe", "x")
    e = Engine(spark, str(tmp_path / "data"))
    rules = spark.createDataFrame([(1, "r", "core", "r/", None, None)], "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string")
    roots = {"documents": str(tmp_path / "docs"), "inbox": str(tmp_path / "inbox"), "jira": str(tmp_path / "missing")}
    assert summary(e.transform_documents(roots, rules)) == (3, 1, 0, 2, 0)
    file = e.table("documents-files").first()
    meta, body = frontmatter.parse(file.content)
    assert file.publish_path.startswith("core/r/one__") and meta["domain"] == "core" and len(meta["aliases"]) == 1 and meta["tags"] == ["documents", "documents", "core"] and "| 1 | 2 |" in body


def test_scraped_files_and_mapping(spark, tmp_path, put):
    put("scrape/wstw/a.json", '{"a": 1}')
    put("scrape/b.html", "<p>" + "long text " * 20 + "</p>")
    put("scrape/c.exe", "x")
    root = put("scrape/empty.csv", "\n")
    e = Engine(spark, str(tmp_path / "data"))
    assert summary(e.transform_scraped(root)) == (4, 3, 1, 0, 0)
    rows = {r.rel_path: r for r in e.table("scraped").collect()}
    record = rows["wstw/a.json"].record
    assert record.warnings == [convert.SHORT_TEXT] and record.markdown_line_count == 5 and record.markdown_char_count == len(rows["wstw/a.json"].markdown) and rows["wstw/a.json"].markdown_path == "scraping/wstw/a.md"
    assert rows["empty.csv"].record.warnings == [convert.EMPTY_TEXT] and rows["b.html"].record.warnings == []
    assert summary(e.transform_scraped(root)) == (4, 0, 4, 0, 0)
    rules = spark.createDataFrame([(1, "r1", "external/wstw", "wstw/", None, None)], "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string")
    mapped = {r.rel_path: r for r in e.map_scraped(rules).collect()}
    assert mapped["wstw/a.json"].target == "external/wstw/wstw/a.md" and mapped["wstw/a.json"].mapping_rule_id == "r1" and mapped["b.html"].domain == "external/unassigned" and mapped["b.html"].title == "b"
    again = scrape.map_to_domains(e.table("scraped"), e.table("scraped"), rules, "now", e.table("mapped").select("target"))
    assert {r.status for r in again.collect()} == {"skipped"}


def test_site_import(spark, tmp_path, put):
    put("site/pages/guide/intro.md", "---\nstatus: reviewed\ntags: [x]\n---\n# Heading\ntext")
    put("site/pages/other-page.md", "plain")
    root = put("site/manifest.json", {"domain": "example.org", "crawl_timestamp": "2024", "pages": [{"path": "old\\pages/guide/intro.md", "title": "no"}, {"file": "x/pages/guide/intro.md", "url": "https://example.org/i", "title": "Intro", "content_type": "html"}, "junk", {"path": "a.pdf"}]})
    e = Engine(spark, str(tmp_path / "data"))
    rows = {r.rel_path: frontmatter.parse(r.content) for r in e.import_site(root, "key").collect()}
    meta, body = rows["guide/intro.md"]
    assert (meta["title"], meta["source_url"], meta["status"], meta["tags"]) == ("Intro", "https://example.org/i", "reviewed", ["x"]) and meta["source_meta"] == {"source_domain": "example.org", "crawl_timestamp": "2024", "content_type": "html"} and body.startswith("# Heading")
    assert rows["other-page.md"][0]["title"] == "other page" and rows["other-page.md"][0]["status"] == "raw"
    put("site/pages/other-page.md", "changed")
    assert {r.rel_path: r.content for r in e.import_site(root, "key").collect()}["other-page.md"].rstrip().endswith("changed")


# ---------------------------------------------------------------- rule files


def test_rule_files(spark, tmp_path):
    from loomlake.operators import terminology
    from loomlake.sources import config

    (tmp_path / "terms.yml").write_text("terms:\n  - id: isu\n    canonical: ISU\n    aliases: [IS-U]\n    relations: [{type: related_to, target: eda}, {type: other, target: x}]\n  - id: isu\n    canonical: ISU2\n  - id: ''\n  - junk\n")
    data = config.read_yaml(str(tmp_path / "terms.yml"))
    assert [(t.term_id, t.canonical, t.label, t.annotate) for t in config.terms(data)] == [("isu", "ISU2", "ISU2", "first_occurrence")]
    frame = config.term_frame(spark, data)
    assert [r.related for r in frame.where("term_id = 'isu'").orderBy("ord").collect()] == [["eda"], []]
    assert {r.code for r in terminology.validate(frame).collect()} == {"duplicate_id", "required_field"}
    assert config.settings({"settings": {"block_min_terms": 1}}).block_min_terms == 1 and config.settings({}).enabled
    rows = {r.source: (r["mode"], r.candidates_enabled) for r in config.modes(spark, {"sources": {"mail": {"mode": False}, "jira": {"mode": True, "candidates_enabled": False}, "bad": 1}}).collect()}
    assert rows == {"mail": ("off", None), "jira": ("annotate_and_block", False)}
    (tmp_path / "list.yml").write_text("- a")
    with pytest.raises(ValueError):
        config.read_yaml(str(tmp_path / "list.yml"))
    (tmp_path / "map.toml").write_text('[mapping]\ndefault_target_subpath = "d"\n[[mapping.rules]]\nid = "r"\ntarget_subpath = "t"\npath_prefix = "p/"\n')
    rules, default = config.mapping_rules(spark, str(tmp_path / "map.toml"))
    assert default == "d" and [tuple(r) for r in rules.collect()] == [(0, "r", "t", "p/", None, None)]
    (tmp_path / "pub.toml").write_text('[publish.confluence]\nmode = "copy"\n[publish.confluence.space_map]\nABC = "domains/core"\n')
    routes, rest = config.publish_routes(spark, str(tmp_path / "pub.toml"))
    assert [tuple(r) for r in routes.collect()] == [("ABC", "domains/core")] and rest == {"mode": "copy"}


def test_terms_of_transformed_pages(spark, tmp_path, put):
    from loomlake.sources import config

    (tmp_path / "terms").mkdir()
    say = lambda name, text: (tmp_path / "terms" / name).write_text(text)
    e = Engine(spark, str(tmp_path / "data"))
    assert {(r.code, r.detail.rpartition("/")[2]) for r in e.validate_terminology(str(tmp_path / "terms")).collect()} == {("missing_file", n) for n in ("settings.yml", "sources.yml", "terms.yml")}
    say("settings.yml", "settings: {block_min_terms: 1}")
    say("sources.yml", "sources:\n  confluence: {mode: annotate_and_block}\n  jira: {mode: [")
    say("terms.yml", "terms:\n  - {id: api, canonical: API, label: interface, description: d, aliases: [Schnittstelle]}\n")
    assert [r.code for r in e.validate_terminology(str(tmp_path / "terms")).collect()] == ["invalid_yaml"]
    say("sources.yml", "- just\n- a list")
    assert [r.code for r in e.validate_terminology(str(tmp_path / "terms")).collect()] == ["load_failed"]
    say("sources.yml", "sources:\n  confluence: {mode: annotate_and_block}\n  jira: {mode: off}\n")
    assert e.validate_terminology(str(tmp_path / "terms")).count() == 0
    say("candidate_exclude.yml", "candidate_exclude:\n  - AP1*\n")
    assert config.glossary(str(tmp_path / "terms")).exclude == ("AP1*",)
    (tmp_path / "terms/candidate_exclude.yml").unlink()
    body = "<p>" + "The API of XYZ and XYZ says a lot. " * 10 + "</p>"
    put("wiki/i/spaces/ABC/by-id/1/metadata.json", {"id": "1", "title": "T", "space": {"key": "ABC"}, "body": body})
    root = put("wiki/i/spaces/ABC/by-id/2/metadata.json", {"id": "2", "title": "U", "space": {"key": "ABC"}, "body": body.replace("API", "AP1")})
    e = Engine(spark, str(tmp_path / "data"), glossary=config.glossary(str(tmp_path / "terms")))
    e.transform_pages(root)
    texts = {r.key: r.content for r in e.table("pages").collect()}
    assert texts["1"].count("API (interface)") == 1 and "## Terminologie\n- API: interface" in texts["1"] and "Terminologie" not in texts["2"]
    found = {r.norm: (r.n, r.action, r.first_seen) for r in e.review_candidates().collect()}
    assert found["xyz"] == (40, "new_term", "1") and found["api"] == (10, "add_alias", "1") and found["ap1"][2] == "2"
    put("wiki/i/spaces/ABC/by-id/2/metadata.json", {"id": "2", "title": "V", "space": {"key": "ABC"}, "body": body})
    e.transform_pages(root)
    again = {r.norm: r for r in e.review_candidates().collect()}
    assert again["xyz"].n == 60 and again["api"].n == 20 and again["ap1"].n == 10 and "The API of XYZ" in again["api"].example_context
    put("jira/projects/by-id/1/metadata.json", {"id": "1", "key": "ABC-1", "fields": {"summary": "A", "description": body}})
    e.transform_issues(str(tmp_path / "jira"))
    assert "interface" not in e.table("issues").first().content and e.review_candidates().where("source = 'jira'").count() == 0


def test_a_transform_goes_on_behind_its_last_part(spark, tmp_path, put, monkeypatch):
    """Parts of about one page; the run is ended in a later part, and the next one renders only what is left."""
    for i in range(6):
        root = put(f"wiki/i/spaces/ABC/by-id/{i}/metadata.json", {"id": str(i), "title": f"Page {i}", "space": {"key": "ABC"}, "body": f"<p>{f'words of page {i} ' * 20}</p>"})
    e = Engine(spark, str(tmp_path / "data"), Settings(commit_every=1, most_parts=3))
    own, calls = DeltaTable.commit, []

    def commit(self, *a, **k):
        if self.root.endswith("/pages-state"):
            calls.append(1)
            if len(calls) == 2:
                raise OSError("ended")
        return own(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(DeltaTable, "commit", commit)
        with pytest.raises(OSError):
            e.transform_pages(root)
    first = e.table("pages-state").count()
    assert 0 < first < 6
    seen = summary(e.transform_pages(root))
    assert seen[:3] == (6, 6 - first, first) and e.table("pages").count() == 6
    assert summary(e.transform_pages(root))[:3] == (6, 0, 6)
