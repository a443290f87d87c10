"""Operators in Python hold a bounded piece of a batch, however long its texts are."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomlake import runtime
from loomlake.operators import markup, terminology
from loomlake.runtime import PIECE_BYTES

MODES = "source string, mode string, candidates_enabled boolean"


def spied(monkeypatch, owner, name, call):
    """The Python function that an operator hands to Spark."""
    got, given = [], getattr(owner, name)

    def spy(*args, **kwargs):
        got.append(next(x for x in args if callable(x)))
        return given(*args, **kwargs)

    with monkeypatch.context() as m:
        m.setattr(owner, name, spy)
        call()
    return got[0]


def test_pieces_hold_all_rows_in_order():
    texts = ["x" * (700_000 if i % 3 else 10) if i % 7 else None for i in range(40)] + ["y" * 3_000_000, ""]
    batches = [pa.record_batch({"i": list(range(len(texts))), "t": texts, "l": [[1, 2]] * len(texts)}), pa.record_batch({"i": pa.array([], pa.int64()), "t": pa.array([], pa.string()), "l": pa.array([], pa.list_(pa.int64()))})]
    out = list(runtime.pieces(iter(batches)))
    assert [x for p in out for x in p["i"].to_pylist()] == list(range(len(texts))) and [x for p in out for x in p["t"].to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 1.1 * PIECE_BYTES for p in out)


def test_terms_are_applied_in_pieces(spark, monkeypatch):
    """a whole batch was held as texts, results and rows; its bytes grew with the input up to Spark's number of rows."""
    terms = [terminology.Term("a", "ALPHA", label="first")]
    docs = spark.createDataFrame([(1, "s", "ALPHA")], "doc_id int, source string, text string")
    run = spied(monkeypatch, F, "arrow_udf", lambda: terminology.apply(docs, terms, spark.createDataFrame([("s", "annotate_and_block", True)], MODES)))
    n = 400
    texts = [None if i == 3 else "so ALPHA " + "x" * 30_000 for i in range(n)]
    batch = (pa.array(texts), pa.array(["s"] * n), pa.array(["annotate_and_block"] * n))
    out = list(run(iter([batch])))
    assert [x["text"] for p in out for x in p.to_pylist()] == [t and t.replace("ALPHA", "ALPHA (first)") for t in texts]
    assert len(out) >= 10 and max(p.nbytes for p in out) < 2 * PIECE_BYTES


def test_matches_are_found_in_pieces(spark, monkeypatch):
    """all matches of a batch were held with their contexts."""
    docs = spark.createDataFrame([(1, "s", "ALPHA")], "doc_id int, source string, text string")
    run = spied(monkeypatch, type(docs), "mapInArrow", lambda: terminology.spans(docs, terminology.CANDIDATE))
    n = 300
    texts = [None if i == 3 else f"AL{i} and " * 1000 for i in range(n)]
    out = list(run(iter([pa.record_batch([pa.array(["s"] * n), pa.array(range(n), pa.int32()), pa.array(texts)], names=["source", "doc_id", "text"])])))
    got = [(r["doc_id"], r["pos"], r["term"]) for b in out for r in b.to_pylist()]
    assert got == [(i, k, f"AL{i}") for i in range(n) if i != 3 for k in range(1000)]
    assert len(out) >= 3 and max(b.num_rows for b in out) < 0.5 * len(got)


def test_pages_are_rendered_in_pieces(spark, monkeypatch):
    """a batch of pages was held as texts, results and rows, each page's markup twice."""
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", {"k": [1]})], "page_id int, url string, html string, more map<string,array<int>>")
    run = spied(monkeypatch, type(pages), "mapInArrow", lambda: markup.render_pages(pages, "html", "url"))
    n = 300
    html = [None if i == 3 else f"<h1>T{i}</h1><p>{'so ' * 10_000}</p>" for i in range(n)]
    given = pa.record_batch({"page_id": pa.array(range(n), pa.int32()), "url": ["u"] * n, "html": html, "more": pa.array([[("k", [1])]] * n, pa.map_(pa.string(), pa.list_(pa.int32()))), "__url": ["u"] * n, "__stem": ["page"] * n, "__properties": [False] * n})
    out = list(run(iter([given])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["page_id"], r["html"], r["markdown"]) for r in rows] == [(i, h, h and f"# T{i}\n{'so ' * 9_999}so" or "") for i, h in enumerate(html)]
    assert len(out) >= 5 and max(b.num_rows for b in out) < 0.2 * n
    table = "<table><tr><td>Owner</td><td>Anna</td></tr></table><table><tr><td colspan='2'>a</td><td>b</td></tr></table>"
    got = markup.render_pages(pages.withColumn("html", F.lit(table)), "html", "url").first()
    assert got.more == {"k": [1]} and got.properties == {"Owner": "Anna"} and got.tables[0].rows.startswith("- Originalzeile 1: Zelle 1=a [span c2/r1]") and got.html == table
    assert markup.render_pages(pages.withColumnRenamed("html", "markdown"), "markdown").select("markdown", "url").first() == ("x", "u")


def test_batches_are_bounded_by_bytes(spark):
    """F7, pipeline: 10,000 rows or 64 MB of texts were one batch, in Spark and in each Python worker."""
    session = spark.newSession()
    runtime.ensure_package(session)
    sizes = lambda batches: (pa.record_batch({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    docs = session.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("text"))
    got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["bytes"] for r in got) < 1.1 * runtime.BATCH_BYTES
    own = spark.newSession()
    own.conf.set(runtime.BATCH_BOUND, "2m")
    runtime.ensure_package(own)
    assert own.conf.get(runtime.BATCH_BOUND) == "2m"
