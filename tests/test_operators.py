"""Behaviour of single operators on small inputs."""

import shutil

import pytest
from pyspark.sql import functions as F

from loomlake.functions import frontmatter
from loomlake.functions import text as tx
from loomlake.operators import audit, chunking, markup, retrieval, state, terminology
from loomlake.sources import exports, readers
from loomlake.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("seconds,text", [(0, "0s"), (59, "59s"), (60, "1m"), (3661, "1h 1m 1s"), (90061, "1d 1h 1m 1s"), (0.4, "0s")])
def test_duration(spark, seconds, text):
    assert one(spark, tx.duration(F.lit(float(seconds)))) == text


def test_text_helpers(spark):
    assert one(spark, tx.slug(F.lit("Über: die Straße!"))) == "über-die-straße"
    assert one(spark, tx.slug(F.lit("!!"), "document")) == "document"
    assert one(spark, tx.title_from_name(F.lit("my_file-name.v2.md"))) == "my file name.v2"
    assert one(spark, tx.property_key(F.lit(" Modul/OFT_Größe "))) == "modul oft groesse"
    assert one(spark, tx.property_list(F.lit("a, b;; c "))) == ["a", "b", "c"]
    assert one(spark, tx.property_list(F.lit(" ;"))) is None
    assert one(spark, tx.occurrences(F.lit("aaaa"), "aa")) == 2
    assert len(one(spark, tx.preview(F.lit("word " * 100)))) <= 260
    assert one(spark, F.lit("a/b/c.md").rlike(tx.glob_to_regex("a/*.md")))
    assert not one(spark, F.lit("a/b/c.mdx").rlike(tx.glob_to_regex("a/*.md")))


@pytest.mark.parametrize("body,want", [("", False), ("# Title\n\n", False), ("  ## x\n", False), ("# T\ntext", True), ("####### seven", True)])
def test_meaningful_content(spark, body, want):
    assert one(spark, tx.has_meaningful_content(F.lit(body))) is want


def test_simple_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(2600))
    rows = chunking.simple_chunks(spark.createDataFrame([(1, text), (2, "  "), (3, None), (4, "ab")], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_start, r.chunk_end) for r in rows] == [(1, 0, 1200), (1, 1050, 2250), (1, 2100, 2600), (4, 0, 2)]
    assert rows[1].text == text[1050:2250] and rows[0].chunk_id == "1-chunk-0000"
    with pytest.raises(ValueError):
        chunking.simple_chunks(spark.createDataFrame([], "doc_id long, text string"), size=10, overlap=10)


@pytest.mark.parametrize("size,overlap", [(10, 8), (10, 0), (7, 3), (10, 9), (1, 0)])
def test_windows_of_any_overlap(spark, size, overlap):
    import random

    rnd = random.Random(size + overlap)
    texts = ["", "a", *("".join(rnd.choice("ab é\U0001f600\nc") for _ in range(rnd.randint(1, 60))) for _ in range(60))]
    for text, got in zip(texts, spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select(chunking.windows(F.col("t"), size, overlap).alias("w")).collect()):
        want, at = [], 0
        while at < len(text):
            want.append(text[at : at + size])
            if at + size >= len(text):
                break
            at += size - overlap
        assert got.w == want, text


def test_sections_fold_and_split_like_a_loop(spark):
    import random
    import re

    rnd = random.Random(4)
    pool = ["# A", "## B  ", "#C", "text", "", "  ", "longer line of text " * 3, "###### six", "####### seven", "# "]
    bodies = ["", "\n\n", "# only", *("\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25))) for _ in range(120))]

    def loop(body, most=120, least=40, overlap=20):
        parts, header, level, lines = [], "", 0, []
        for line in [*body.strip().split("\n"), None]:
            if line is None or re.match(r"#{1,6}\s+", line):
                content = "\n".join(lines).strip()
                if header or content:
                    parts.append([header, level, content])
                if line is not None:
                    level = len(re.match("#+", line).group())
                    header, lines = re.sub(r"^#{1,6}\s+", "", line).strip(), []
            else:
                lines.append(line)
        said = lambda p: "\n".join(x for x in ("#" * p[1] + " " + p[0] if p[0] else "", p[2]) if x)
        merged = []
        for p in parts:
            if merged and len(said(p)) < least:
                merged[-1][2] = "\n\n".join(x for x in (merged[-1][2], said(p)) if x)
            else:
                merged.append(list(p))
        out = []
        for n, p in enumerate(merged):
            text, at = said(p), 0
            while True:
                piece = text[at : at + most].strip() if len(text) > most else text
                if piece:
                    out.append((n, at, p[0], p[1], piece))
                if len(text) <= most or at + most >= len(text):
                    break
                at += most - overlap
        return out

    rows = chunking.markdown_chunks(spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string"), most=120, least=40, overlap=20)
    got = {}
    for r in rows.orderBy("doc_id", "part", "chunk_start").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, body in enumerate(bodies):
        assert got.get(i, []) == loop(body), body


def test_chunkers_take_time_in_proportion_to_the_text(spark):
    """Four times the text in at most six times the time, with a fixed second for the job itself."""
    import time

    def seconds(make, n):
        frame = make(n)
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    one = lambda text, name: spark.createDataFrame([(1, text)], f"doc_id int, {name} string").coalesce(1)
    for make in (
        lambda n: chunking.simple_chunks(one("some words é " * (n * 80_000), "text")),
        lambda n: chunking.markdown_chunks(one(("line of the text\n" * 9 + "# head\n") * (n * 1000), "body")),
        lambda n: chunking.markdown_chunks(one("# head\n" + "line of the text\n" * (n * 20_000), "body")),
    ):
        seconds(make, 1)  # compiled
        assert seconds(make, 8) <= 6 * seconds(make, 2) + 1


def test_markdown_chunks_merge_and_split(spark):
    body = "intro\n# A\n" + "x" * 300 + "\n## small\nfew\n# B\n" + "y" * 2500
    rows = chunking.markdown_chunks(spark.createDataFrame([(1, body)], "doc_id long, body string")).orderBy("part", "chunk_start").collect()
    assert [r.section_header for r in rows] == ["", "A", "B", "B", "B"]
    assert "## small" in rows[1].text and all(len(r.text) <= 1200 for r in rows)


def chunk_rows(spark):
    return spark.createDataFrame([(1, "a", "Alpha beta", "the alpha", "sec alpha", ["alpha"]), (2, "b", "nothing", "x", None, None), (3, "c", None, None, None, [])], "doc_id long, chunk_id string, text string, title string, section_header string, tags array<string>")


def test_keyword_scores_and_nulls(spark):
    q = [retrieval.Question(1, "Alpha beta"), retrieval.Question(2, "  ")]
    rows = retrieval.keyword_search(chunk_rows(spark), q, 5).collect()
    assert [(r.query_id, r.chunk_id) for r in rows] == [(1, "a")]
    assert rows[0].score == pytest.approx(1 + 1 + 2.5 + 1.5 + 1.2 + 1.5)


def test_cosine_guards(spark):
    assert one(spark, retrieval.cosine(F.array(F.lit(1.0), F.lit(0.0)), (1.0, 0.0))) == 1
    assert one(spark, retrieval.cosine(F.array(F.lit(1.0)), (1.0, 0.0))) == 0
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0), F.lit(0.0)), (1.0, 0.0))) == 0


def test_source_filter_widens_aliases(spark):
    rows = spark.createDataFrame([("website",), ("scraping",), ("wiki",), (None,)], "source_type string")
    assert {r[0] for r in retrieval.source_filter(rows, ["WEB"]).collect()} == {"website", "scraping"}
    assert retrieval.source_filter(rows, []).count() == 4


def test_dedupe_keeps_the_first_and_fills_up(spark):
    rows = spark.createDataFrame([(1, 1, "k"), (1, 2, "k"), (1, 3, "m"), (1, 4, "n")], "query_id int, rank int, key string")
    assert [r["rank"] for r in retrieval.dedupe_backfill(rows, F.col("key"), 2).orderBy("rank").collect()] == [1, 3]


def test_flat_rerank_scores_fall_back(spark):
    rows = spark.createDataFrame([(1, 0.0025, 1), (1, 0.0025, 2), (2, 0.9, 1), (2, 0.1, 2), (3, 0.9, 1)], "query_id int, rerank_score double, rerank_rank int")
    assert {r[0]: r[1] for r in retrieval.guardrail(rows).collect()} == {1: True, 2: False, 3: False}


@pytest.mark.parametrize("answer,want", [("So [Source 1].", "So [1]."), ("So", "So [1] [3]"), ("", "Keine Antwort generiert. [1] [3]"), (None, "Keine Antwort generiert. [1] [3]")])
def test_citations(spark, answer, want):
    assert one(spark, retrieval.normalise_citations(F.lit(answer).cast("string"), F.array(F.lit(3), F.lit(1), F.lit(3)))) == want


def events(spark, rows):
    names = "id run_id document_id stage status reason_code chunk_count output_count input_count created_at source_type source_instance document_title message document_uri extra_json".split()
    full = [tuple((dict(id=i, run_id="r", source_type="wiki") | r).get(n) for n in names) for i, r in enumerate(rows)]
    schema = "id long, run_id string, document_id string, stage string, status string, reason_code string, chunk_count int, output_count int, input_count int, created_at string, source_type string, source_instance string, document_title string, message string, document_uri string, extra_json string"
    return spark.createDataFrame(full, schema)


def test_funnel_and_drilldown(spark):
    e = events(spark, [
        dict(document_id="a", stage="load", status="ok", created_at="1"), dict(document_id="b", stage="load", status="ok", created_at="1"),
        dict(document_id="b", stage="filter", status="skipped", reason_code="unchanged_incremental", created_at="2"),
        dict(document_id="a", stage="transform", status="warning", created_at="3", extra_json='{"changed_flag": false, "warning_flags": ["w2", "w1"]}', output_count=7),
        dict(document_id="a", stage="chunk", status="ok", chunk_count=3, created_at="4"), dict(document_id=None, stage="load", status="ok", created_at="5"),
    ])
    f = audit.funnel(e).first()
    assert (f.loaded, f.unchanged_skipped, f.candidate_for_transform, f.transformed_ok, f.chunks_created, f.problematic_dropoff) == (2, 1, 1, 1, 3, 0)
    rows = {r.document_id: r for r in audit.drilldown(e).collect()}
    assert rows["a"].warning_flags == "w1|w2" and rows["a"].transformed_text_length == 7 and rows["a"].changed_flag is False
    assert rows["b"].is_problematic is False


def test_change_status_asks_for_outputs(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "key string, checksum string")
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, checksum string")
    there = spark.createDataFrame([("a",)], "key string")
    assert {r.key: r.status for r in state.change_status(now, before, outputs=there).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}


def test_terms():
    terms = [terminology.Term("t", "API", ("Schnittstelle",), "interface", related=("p", "gone")), terminology.Term("p", "Anna", (), "a person", term_class="person"), terminology.Term("x", "und", block="exclude", annotate="never")]
    found = terminology.match("Die API und die API von Anna; APIs nicht", terms)
    assert terminology.annotate("Die API und die API von Anna; APIs nicht", found) == ("Die API (interface) und die API von Anna; APIs nicht", 1)
    assert [m[3] for m in terminology.match("api Schnittstelle", terms)] == ["api", "Schnittstelle"]
    assert terminology.block(terminology.match("Anna API", terms), terms) == "\n## Terminologie\n- Anna: a person\n- API: interface\n  - Verwandte Begriffe: Anna\n"
    assert terminology.block(terminology.match("Anna API", terms), terms, aliases=True).endswith("  - Aliase: Schnittstelle\n")
    assert terminology.block(terminology.match("API und", terms), terms) == ""


def test_terms_by_source_mode(spark):
    terms = [terminology.Term("a", "ALPHA", label="first"), terminology.Term("b", "BETA", label="second", applies_to=("wiki",))]
    docs = spark.createDataFrame([(1, "wiki", "ALPHA BETA "), (2, "mail", "ALPHA BETA"), (3, "chat", "ALPHA"), (4, None, "ALPHA"), (5, "wiki", None)], "doc_id int, source string, text string")
    modes = spark.createDataFrame([("wiki", "annotate_and_block", None), ("mail", "block_only", False), ("chat", "off", True)], "source string, mode string, candidates_enabled boolean")
    got = {r.doc_id: r for r in terminology.apply(docs, terms, modes).collect()}
    assert got[1].text == "ALPHA (first) BETA (second)\n\n## Terminologie\n- ALPHA: first\n- BETA: second\n" and got[1].annotations == 2
    assert got[2].text == "ALPHA BETA" and got[2].n_matches == 1 and not got[2].block_added
    assert got[3].text == "ALPHA" and got[3].n_matches == 0 and got[4].n_matches == 0 and got[5].text is None
    gate = {r.doc_id: (r["mode"], r.candidates) for r in terminology.source_modes(docs, modes).collect()}
    assert gate == {1: ("annotate_and_block", True), 2: ("block_only", False), 3: ("off", False), 4: ("off", False), 5: ("annotate_and_block", True)}


def test_candidate_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "wiki", "x " * 40 + "ALPHA first ALPHA"), (2, "wiki", "again ALPHA and BETA-x"), (3, "mail", "INFO ALPHA")], "doc_id int, source string, text string")
    rows = terminology.candidates(docs, terminology.CANDIDATE, exclude=["info"])
    got = {(r.source, r.norm): r for r in rows.collect()}
    assert got[("wiki", "alpha")].n == 3 and got[("wiki", "alpha")].example_context == "x " * 20 + "ALPHA first ALPHA" and ("mail", "info") not in got
    report = rows.select(F.col("source").alias("source_type"), "term", F.col("n").alias("count"), F.col("first_seen").alias("first_seen_file"), F.col("last_seen").alias("last_seen_file"), "example_context", *[F.lit(d).alias(n) for n, d in list(terminology.REPORT.items())[6:]])
    path = str(tmp_path / "report")
    assert terminology.write_report(report, path) and not terminology.write_report(report.limit(0), path)
    back = terminology.read_report(spark, path)
    assert [(r.source_type, r.term, r["count"]) for r in back.collect()] == [("mail", "ALPHA", 1), ("wiki", "ALPHA", 3), ("wiki", "BETA-x", 1)]
    (tmp_path / "old.csv").write_text("source_type,term,count\nwiki,PM,2\nwiki,NEU,bad\n")
    old = {r.term: r for r in terminology.read_report(spark, str(tmp_path / "old.csv")).collect()}
    assert old["PM"]["count"] == 2 and old["NEU"]["count"] == 0 and old["PM"].reviewer_status == "open" and old["PM"].suggested_action == "needs_review"


MACRO = '<ac:structured-macro ac:name="{}">{}</ac:structured-macro>'


def test_markup():
    text, r = markup.to_markdown("<h1>T</h1><p>a <b>bold</b> <a href='http://x/y'>link</a><br/>next</p><ul><li>one</li><li>two</li></ul>")
    assert text == "# T\na **bold** [link](http://x/y)\nnext\n\n- one\n- two"
    text, r = markup.to_markdown(MACRO.format("info", "<ac:rich-text-body><p>careful</p></ac:rich-text-body>") + MACRO.format("toc", "") + MACRO.format("mystery", "<ac:rich-text-body>kept</ac:rich-text-body>"))
    assert "> **INFO:** careful" in text and "kept" in text and r.unsupported == ["mystery"]
    nested = MACRO.format("expand", '<ac:parameter ac:name="title">More</ac:parameter><ac:rich-text-body>' + MACRO.format("note", "<ac:rich-text-body>deep</ac:rich-text-body>") + "</ac:rich-text-body>")
    assert "## More" in markup.to_markdown(nested)[0] and "> **NOTE:** deep" in markup.to_markdown(nested)[0]
    assert "```plantuml\nA -> B\n```" in markup.to_markdown(MACRO.format("plantuml", "<ac:plain-text-body><![CDATA[A -> B]]></ac:plain-text-body>"))[0]


def test_tables():
    text, r = markup.to_markdown("<table><tr><th>Status</th><td>open</td></tr><tr><th>Owner</th><td>Anna</td></tr></table>")
    assert r.properties == {"Status": "open", "Owner": "Anna"} and "- **Status:** open" in text
    text, r = markup.to_markdown("<table><tr><th>A</th><th>B</th><th>C</th></tr><tr><td>1|2</td><td>2</td><td>3</td></tr></table>")
    assert "| A | B | C |" in text and "1\\|2" in text
    text, r = markup.to_markdown("<table>" + "<tr><td>1</td><td>2</td><td>3</td></tr>" * 16 + "</table>")
    assert r.warnings == [] and r.tables == [("Zeilen=16, Spalten=3, nested_table=False, spans=False", "\n".join(f"- Originalzeile {i}: Zelle 1=1 | Zelle 2=2 | Zelle 3=3" for i in range(1, 17)))]
    assert text == "[Komplexe Tabelle ausgelagert: page__table_01.md]\nHinweis: rows=16, cols=3, nested=False, spans=False."
    wide = "<table><tr><th>A</th><th></th></tr><tr><td colspan='2'>x</td></tr><tr><td>1</td><td></td><td>3</td></tr></table>"
    text, r = markup.to_markdown(wide * 2, stem="7__p")
    assert "7__p__table_01.md]\nHinweis: rows=3, cols=3, nested=False, spans=True." in text and "7__p__table_02.md]" in text
    assert r.tables[1] == ("Zeilen=3, Spalten=3, nested_table=False, spans=True", "- Zeile 1: A=x [span c2/r1]\n- Zeile 2: A=1 | Spalte 2=(leer) | Spalte 3=3")

    many = "<table>" + "<tr><th>K</th><td>v</td><td>more</td></tr>" * 16 + "</table>"
    for own, want in ((False, "Zelle 1=K | Zelle 2=v | Zelle 3=more"), (True, "Zelle 1=K | Zelle 2=v")):
        text, r = markup.to_markdown(many.replace("<td>more", "<td rowspan='2'>more"), properties=own)
        assert r.tables[0][0].startswith("Zeilen=16, Spalten=3") and r.tables[0][1].split("\n")[0].split(" [")[0] == f"- Originalzeile 1: {want}"


def test_warnings_have_codes_and_words():
    text, r = markup.to_markdown(MACRO.format("mystery", "") + MACRO.format("a b!", "<ac:rich-text-body>in</ac:rich-text-body>") + MACRO.format("plantuml", "") + MACRO.format("jira", "") + MACRO.format("view-file", ""))
    assert list(zip(r.warnings, r.messages)) == [
        ("unsupported_macro", "Nicht unterstütztes Makro erkannt: mystery"), ("macro_name_parse_error", "Ungültiger Makroname erkannt und auf unknown_macro gesetzt: a b!"), ("unsupported_macro", "Nicht unterstütztes Makro erkannt: unknown_macro"),
        ("degraded_macro_rendering", "PlantUML-Makro ohne lesbaren CDATA-Body erkannt."), ("degraded_macro_rendering", "Jira-Makro ohne verwertbare Details erkannt."), ("degraded_macro_rendering", "view-file-Makro ohne Dateidetails erkannt."),
    ]
    assert r.unsupported == ["mystery", "unknown_macro"] and "in" in text


def test_tasks():
    user = '<ri:user ri:display-name="Anna"/>'
    task = "<ac:task><ac:task-status>{}</ac:task-status><ac:task-body>{}</ac:task-body></ac:task>"
    text, r = markup.to_markdown("<ac:task-list>" + task.format("incomplete", user + " Bericht bis 2024-05-01 senden") + task.format("complete", user + " ok") + task.format("complete", "niemand") + "</ac:task-list>")
    assert [t.drop for t in r.tasks] == ["", "trivial_communication", "missing_mention"]
    assert "## Open Tasks" in text and "2024-05-01" in text and "Completed" not in text


def test_empty_headings():
    assert markup.drop_empty_headings("# A\n\n## B\n\n# C\ntext") == "\n# C\ntext" or markup.drop_empty_headings("# A\n\n## B\n\n# C\ntext").strip() == "# C\ntext"


def test_front_matter():
    data, body = frontmatter.parse("---\ntitle: T\ntags: a, b\nzero: 0\nempty: ''\n---\n\nbody")
    assert data["tags"] == ["a", "b"] and body == "body"
    assert list(frontmatter.normalise(data)) == ["title", "tags", "zero"]
    assert frontmatter.parse("no front matter") == ({}, "no front matter")
    assert frontmatter.parse("---\na: [\nb: 2\n---\nx")[0]["b"] == "2"
    assert frontmatter.problems({"title": "x", "status": "odd"}) == ["missing: source_type", "missing: source_system", "missing: source_key", "invalid: status"]
    assert frontmatter.parse(frontmatter.render({"title": "Ü", "source_meta": {"k": 1}}, "b"))[0] == {"title": "Ü", "source_meta": {"k": 1}}


def test_readers(spark, tmp_path):
    (tmp_path / "md/sub").mkdir(parents=True)
    (tmp_path / "md/sub/a.md").write_text("# T\ncontent")
    (tmp_path / "md/empty.md").write_text("# only a heading\n")
    (tmp_path / "md/README.md").write_text("text")
    assert [r.rel_path for r in readers.markdown_documents(spark, str(tmp_path / "md")).collect()] == ["sub/a.md"]
    page = tmp_path / "wiki/by-id/7"
    page.mkdir(parents=True)
    (page / "metadata.json").write_text('{"id": "7", "title": "P", "space": {"key": "AB"}, "body": "from json"}')
    (page / "content.storage.xml").write_text("<p>x</p>")
    assert [(r.page_id, r.body) for r in exports.wiki_pages(spark, str(tmp_path / "wiki"), ["ab"]).collect()] == [("7", "<p>x</p>")]
    issue = tmp_path / "issues/AB-1"
    issue.mkdir(parents=True)
    (issue / "metadata.json").write_text('{"key": "AB-1", "summary": "old"}')
    (issue / "content.storage.json").write_text('{"key": "AB-1", "fields": {"summary": "new"}}')
    assert [(r.issue_key, r.project_key, r.summary) for r in exports.issues(spark, str(tmp_path / "issues")).collect()] == [("AB-1", "AB", "new")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.jsonl").write_text('{"doc_id": "d", "chunk_id": "d-0", "text": "t"}\nbroken\n{"doc_id": "d", "chunk_id": "d-1", "text": " "}\n')
    assert [(r.chunk_id, r.title) for r in readers.chunk_files(spark, str(tmp_path / "c")).collect()] == [("d-0", "d")]


def test_stream_ingests_changes_once(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key string, text string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("a", "x"), ("b", "changed")], "key string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.key, r.text) for r in spark.read.parquet(str(tmp_path / "out/chunks/*")).collect()) == [("a", "x"), ("b", "changed"), ("b", "y")]
    assert ingest.current_state(spark, str(tmp_path / "out")).count() == 2
    assert sorted((r.key, r.text) for r in ingest.current_chunks(spark, str(tmp_path / "out")).collect()) == [("a", "x"), ("b", "changed")]


@pytest.mark.parametrize("step", ["chunks", "state", "commits", "all"])
def test_a_repeated_batch_keeps_its_chunks(spark, tmp_path, monkeypatch, step):
    """A batch fails after each of its writes and is run again."""
    root = str(tmp_path / "out")
    docs = spark.createDataFrame([("a", "x", 1), ("a", "newer", 2), ("b", "y", 1), ("c", None, 1), (None, "z", 1)], "key string, text string, n int")
    ingest.ingest_batch(docs.where("key = 'b'"), 0, root, "n")
    if step == "all":
        ingest.ingest_batch(docs, 1, root, "n")
    else:
        real = ingest._folder

        def failing(s, path):
            if path.endswith("commits/1"):
                raise OSError("lost")
            return real(s, path)

        monkeypatch.setattr(ingest, "_folder", failing)
        with pytest.raises(OSError):
            ingest.ingest_batch(docs, 1, root, "n")
        monkeypatch.setattr(ingest, "_folder", real)
        assert ingest.committed(spark, root) == [0]
        assert [r.key for r in ingest.current_chunks(spark, root).collect()] == ["b"]
        if step == "chunks":
            shutil.rmtree(f"{root}/state/batch=1")
        elif step == "state":
            shutil.rmtree(f"{root}/chunks/batch=1")
    for _ in range(2):
        ingest.ingest_batch(docs, 1, root, "n")
        assert sorted((r.key, r.text) for r in ingest.current_chunks(spark, root).collect()) == [("a", "newer"), ("b", "y")]
        assert ingest.current_state(spark, root).count() == 3
    ingest.ingest_batch(docs, 2, root, "n")
    assert spark.read.parquet(f"{root}/chunks/batch=2").count() == 0


class Echo:
    name = "echo"

    def __init__(self):
        self.prompts = []

    def generate(self, prompt):
        self.prompts.append(prompt)
        return "It is so [Source 1]"


def test_ask_from_question_to_answer(spark):
    from loomlake.operators import answer

    rows = [(1, "1", "the cat sits on the mat", "Cats"), (2, "2", "the cat sits on the mat", "Cats"), (3, "3", "dogs run in the park", "Dogs"), (4, "4", None, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, text string, title string")
    embedder, echo = answer.HashEmbedder(16), Echo()
    vectors = spark.createDataFrame([(r[0], r[1], v) for r, v in zip(rows, embedder.embed([r[2] or "" for r in rows]))], "doc_id long, chunk_id string, embedding array<double>")
    got = answer.ask(chunks, vectors, "cat mat", embedder, answer.LexicalReranker(), echo)
    assert got["answer"] == "It is so [1]" and [s["title"] for s in got["sources"]][:1] == ["Cats"]
    assert sum(s["title"] == "Cats" for s in got["sources"]) == 1 and "SOURCE 1" in echo.prompts[0]
    silent = Echo()
    assert answer.ask(chunks, vectors, "zzz", embedder, None, silent)["answer"] is not None or silent.prompts == []
    with pytest.raises(ValueError):
        answer.check_index({"model": "a"}, "p", "b")
    answer.check_index({}, "p", "b")


# ---------------------------------------------------------------- terms in texts


def looked_up(text, terms, source=None):
    """Each form of each term by a pattern of its own."""
    import re

    found = []
    for order, t in enumerate(terms):
        if t.applies_to and source not in t.applies_to:
            continue
        spans = {}
        for form in sorted({f for f in (t.canonical, *t.aliases) if f}, key=len, reverse=True):
            for m in re.finditer(rf"(?<!\w){re.escape(form)}(?!\w)", text, 0 if t.case_sensitive else re.IGNORECASE):
                spans.setdefault(m.span(), m.group())
        if spans:
            own = sorted(spans.items())
            found.append((own[0][0][0], order, [(a, b, t, said) for (a, b), said in own]))
    return [hit for _, _, hits in sorted(found, key=lambda x: x[:2]) for hit in hits]


def test_automaton_finds_what_patterns_find():
    import random

    rnd = random.Random(8)
    alphabet = ["a", "A", "b", "B", "ß", "ẞ", "ss", "İ", "i", "ı", "ſ", "s", "K", "k", "µ", "μ", "é", "É", " ", " ", "-", ".", "_", "1", "Σ", "ς", "ﬅ", "ﬆ", "\U00010400", "\U00010428"]
    word = lambda n: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, n)))
    for _ in range(300):
        terms = [terminology.Term(f"t{i}", word(3), tuple(word(4) for _ in range(rnd.randint(0, 3))), case_sensitive=rnd.random() < 0.3, applies_to=("x",) if rnd.random() < 0.2 else ()) for i in range(rnd.randint(1, 8))]
        text = "".join(rnd.choice([rnd.choice(alphabet), rnd.choice(terms).canonical, *(t.swapcase() for t in rnd.choice(terms).aliases)]) for _ in range(60))
        for source in (None, "x"):
            assert terminology.match(text, terms, source) == looked_up(text, terms, source), (text, terms)


def test_folding_joins_what_patterns_join():
    import re

    for point in range(0x110000):
        x = chr(point)
        for y in {x.lower(), x.upper(), x.swapcase(), x.casefold()} - {x}:
            if len(y) == 1 and re.fullmatch(re.escape(x), y, re.IGNORECASE):
                assert terminology.fold(x) == terminology.fold(y), (x, y)
        if 0xD800 <= point < 0xE000:
            continue
        assert len(terminology.fold(x)) == 1


def test_fifty_thousand_forms(spark):
    """As many forms as a large glossary has: right on a sample, and no slower than a hundred times fewer."""
    import time

    docs = [(i, " ".join(f"w{(i * 37 + j * j) % 60_000}" for j in range(200)) + " New York, new york!", "s") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    terms = [terminology.Term(f"t{k}", f"w{k}", (f"W{k} w{k + 1}", "new york" if k == 7 else "")) for k in range(0, 50_000, 2)]
    got = {tuple(r) for r in terminology.occurrences(frame, terms, source="source").collect()}
    split = {tuple(r) for r in terminology.occurrences(frame, terms, source="source", most=120_000).collect()}
    assert got == split and len(terminology.parts_of(terms, 120_000)) > 3
    for i, text, _ in docs[:3]:
        few = [t for t in terms if t.canonical in text.split() or t.term_id == "t14"]
        assert {(i, a, b, t.term_id, said) for a, b, t, said in looked_up(text, few)} == {r for r in got if r[0] == i}
    text = docs[0][1] * 40
    long = terminology.Term("long", "ab " * 2000 + "end", ("x" * 100_000,))
    told = "ab " * 4000 + "END, " + "X" * 100_000
    assert terminology.match(told, [long]) == looked_up(told, [long]) != []

    def seconds(some):
        forms = terminology.Forms(some)
        began = time.perf_counter()
        forms.match(text)
        return time.perf_counter() - began

    assert min(seconds(terms) for _ in range(3)) < 5 * min(seconds(terms[:250]) for _ in range(3)) + 0.05
    with pytest.raises(ValueError):
        terminology.apply(frame, [terminology.Term("x", "y" * (terminology.MOST_CHARS + 1))], spark.createDataFrame([("s", "off", None)], "source string, mode string, candidates_enabled boolean"))


def test_candidates_of_null_sources(spark):
    docs = spark.createDataFrame([(1, None, "The API is here"), (2, "s", "API"), (3, None, None), (4, None, "no more API, API")], "doc_id long, source string, text string")
    rows = terminology.candidates(docs, terminology.CANDIDATE)
    got = {(r.source, r.norm): (r.n, r.first_seen, r.last_seen, r.example_context) for r in rows.collect()}
    assert got == {(None, "api"): (3, 1, 4, "The API is here"), ("s", "api"): (1, 2, 2, "API")}
    twice = {(r.source, r.norm): r.n for r in terminology.merge_report(rows, rows).collect()}
    assert twice == {(None, "api"): 6, ("s", "api"): 2}
    places = [(r.doc_id, r.begin, r.end, r.term) for r in terminology.spans(docs, terminology.CANDIDATE).orderBy("doc_id", "pos").collect()]
    assert places == [(1, 4, 7, "API"), (2, 0, 3, "API"), (4, 8, 11, "API"), (4, 13, 16, "API")]


# ---------------------------------------------------------------- passages, tables, ties


def test_passages_differ_by_source_and_not_by_case(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a", "T", "S", "Some text"), (1, 2, "A ", " t", "s", " some TEXT "), (1, 3, "b", "T", "S", "Some text"), (1, 4, "a", "T", "S", "Some text " + "x" * 700), (1, 5, "a", "T", "S", "some text " + "X" * 600 + "other")],
        "query_id int, rank int, ref string, title string, section string, text string")
    key = retrieval.dedupe_key(F.col("ref"), F.col("title"), F.col("section"), F.col("text"))
    assert [r.rank for r in retrieval.dedupe_backfill(rows, key).orderBy("final_rank").collect()] == [1, 3, 4]


def test_rows_of_nested_tables():
    """An outer row that reads like a row of a nested table stays, and time grows with the tables."""
    import time

    row = "<tr><td>a</td><td>b</td><td>c</td></tr>"
    text, r = markup.to_markdown(f"<table>{row}<tr><td><table>{row}</table></td><td>x</td><td>y</td></tr></table>")
    assert r.tables[-1][1].startswith("- Originalzeile 1: Zelle 1=a | Zelle 2=b | Zelle 3=c\n") and "[Komplexe Tabelle ausgelagert: page__table_" in text

    def seconds(n):
        html = "<table>" + "<tr><td><table><tr><td>1</td></tr></table></td></tr>" * n + "</table>"
        began = time.perf_counter()
        markup.to_markdown(html)
        return time.perf_counter() - began

    seconds(50)
    assert seconds(1600) < 8 * seconds(400) + 0.2


def test_equal_drops_go_to_the_latest_run(spark):
    f = spark.createDataFrame([("r1", 5), ("r2", 5), ("r3", 1), ("r4", 5)], "run_id string, expected_dropoff long")
    runs = spark.createDataFrame([("r1", "2024-01-01 00:00:00"), ("r2", "2024-03-01 00:00:00"), ("r3", "2024-05-01 00:00:00"), ("r4", None)], "run_id string, started_at string")
    runs = runs.withColumn("started_at", F.col("started_at").cast("timestamp"))
    assert tuple(audit.largest_drop(f, "expected_dropoff", runs).first()) == ("r2", 5)


# ---------------------------------------------------------------- indexes


def test_postings_find_what_a_scan_finds(spark):
    import random

    from loomlake.operators import postings

    rnd = random.Random(6)
    letters = ["ab", "bc", "é", "\U0001f600", "İ", " ", "x", "Yz", "_"]
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9)))
    rows = [(f"d{i}", f"c{i}", word() if i % 7 else None, word(), word() if i % 3 else None, [word()] if i % 2 else None) for i in range(400)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, title string, section_header string, tags array<string>").repartition(4)
    built = postings.build(chunks)
    assert built.count() == built.distinct().count()
    questions = [retrieval.Question(i, t) for i, t in enumerate(["abbc", "Yzx abab", "ab", "bcé", "\U0001f600ab", "zzzz", "", "xyz abbc x", "éab_ab"])]
    assert {q.text for q in questions if postings.by_postings(q)} == {"abbc", "Yzx abab", "bcé", "zzzz", "éab_ab"}
    key = lambda frame: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in frame.collect())
    for named in (1000, 0):
        postings.NAMED = named
        assert key(postings.keyword_search(chunks, built, questions, 5)) == key(retrieval.keyword_search(chunks, questions, 5))
    postings.NAMED = 1000
    assert postings.candidates(built, questions[5:6]).count() == 0


def test_cells_find_what_a_scan_finds(spark, tmp_path):
    import numpy as np

    from loomlake.operators import vector_index

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 4
    data = [(f"d{i}", f"c{i}", (centres[i % 12] + rng.normal(size=16) * 0.5).tolist()) for i in range(1500)]
    data += [("dup", f"e{i}", data[3][2]) for i in range(40)] + [("z", "zero", [0.0] * 16), ("s", "short", [1.0, 2.0]), ("n", "none", None), ("m", "hole", [None] * 16)]
    vectors = spark.createDataFrame(data, "doc_id string, chunk_id string, embedding array<double>").repartition(4)
    vector_index.build(vectors, str(tmp_path / "i"), cells=24, sample=400)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    ask = [retrieval.Question(i, "", tuple(v)) for i, v in enumerate([data[0][2], data[3][2], rng.normal(size=16).tolist(), (-centres[2]).tolist(), [0.0] * 16, [1.0]])]
    key = lambda frame: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in frame.collect())
    for k in (1, 7, 60):
        assert key(index.search(ask, k)) == key(retrieval.vector_search(vectors.where("embedding IS NOT NULL"), ask, k))
    assert index.share(ask[:1], 7) < 0.3 and sum(index.sizes.values()) == 1540
    vector_index.build(vectors.limit(0), str(tmp_path / "none"))
    assert vector_index.VectorIndex(spark, str(tmp_path / "none")).search(ask, 5).count() == 0


def test_first_rule_of_thousands(spark):
    import random

    from loomlake.operators import scrape

    rnd = random.Random(12)
    part = lambda n: "".join(rnd.choice("ab/._A") for _ in range(rnd.randint(1, n)))
    rules = [(k, f"r{k}", f"t{k}", *(part(n) if rnd.random() < 0.6 else rnd.choice([None, ""]) for n in (5, 4, 4))) for k in range(5000) if k % 50]
    rules = [r for r in rules if any(r[3:])]
    paths = [None, "", "a\\b/A.b", *(part(14) for _ in range(400))]

    def loop(path, some):
        if path is not None:
            p = path.replace("\\", "/")
            for _, i, t, prefix, inside, name in some:
                if p.startswith(prefix or "") and (inside or "") in p and (name or "").lower() in p.rpartition("/")[2].lower():
                    return i, t
        return "default", "d"

    schema = "ord int, id string, target_subpath string, path_prefix string, path_contains string, file_name_contains string"
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, rel_path string")
    for some in (rules, rules[:40], rules[:3] + [(9999, "rest", "t", None, None, "")], []):
        shuffled = rnd.sample(some, len(some))
        got = scrape.choose_rule(rows, spark.createDataFrame(shuffled, schema), default="d")
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r.i: (r.rule_id, r.target_subpath) for r in got.collect()} == {i: loop(p, some) for i, p in enumerate(paths)}


def test_deletion_plan_of_paths_with_two_sizes(spark):
    """a path listed with two sizes was one target, its size picked by chance."""
    rows = spark.createDataFrame([("a", "/r/x", 1), ("a", "/r/x", 5), ("a", "/r/x", 5), ("a", "/r/y", None), ("b", "/r/z", None), ("b", "/other", 9)], "category string, path string, size long").repartition(3)
    assert sorted(map(tuple, state.deletion_plan(rows, ["/r"]).collect())) == [("a", 3, 6), ("b", 1, None)]
