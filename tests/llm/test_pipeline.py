"""The pipeline's stages by brute force on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_llm import brute_classes, brute_quality

import corpus_pipeline as p
from loomlake.llm import bpe, pii
from loomlake.llm.queries import vocabulary

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with near copies, leaks, personal data, junk and nulls, and its benchmark and labels."""
    root = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(120)]
        if i % 6 == 1 and docs[-1][1]:
            w = docs[-1][1].split()
            w[50] = word()
        if i % 10 == 3:
            w[40:40] = item
        if i % 10 == 5:
            w[20:20] = ["reach", "bob@mail.example.com", "soon"]
        if i % 10 == 7:
            w = [x.upper() + "***" for x in w]
        docs.append((i, " ".join(w), "en", "s", 1))
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "short text", "en", "s", 10), (None, " ".join(word() for _ in range(100)), "en", "s", 1)]
    docs += [(200, " ".join(word() for _ in range(60_000)), "en", "s", 1)]
    spark.createDataFrame(docs, COLUMNS).withColumn("kept", F.lit("clash")).withColumn("leaks", F.lit(1)).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 10 != 7), 0) for i in range(60)] + [(0, 0, 1), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, docs, " ".join(item)


def test_stages(spark, tables):
    root, docs, item = tables
    frame = spark.read.parquet(f"{root}/documents.parquet")
    rows = {}
    for name, stage in p.STAGES:
        frame = stage(spark, frame, root)
        got = frame.collect()
        frame = spark.createDataFrame(got, frame.schema)
        rows[name] = {r.doc_id: r for r in got}
        assert frame.columns == p.COLUMNS or name == "encoding"
    given = {d[0]: d[1] for d in docs}
    kept = set(rows["quality_rules"])
    assert kept == {i for i, t in given.items() if not brute_quality(t)[-1] and not (i is not None and i % 10 == 7)}
    label = brute_classes([(i, given[i]) for i in kept if i is not None], 5, 80)
    assert set(rows["near_copies"]) == {i for i in kept if i is None or label[i][1] == i}
    assert set(rows["decontamination"]) == {i for i in rows["near_copies"] if item not in given[i]}
    assert set(rows["personal_data"]) == set(rows["decontamination"])
    for i, r in rows["personal_data"].items():
        assert r.text == pii.redact(given[i], pii.find([given[i]])[1][0]) and r.n_chars == len(r.text)
    own = bpe.load(vocabulary())
    assert {i: own.decode(r.ids) for i, r in rows["encoding"].items()} == {i: r.text for i, r in rows["personal_data"].items()}
    assert all(r.exact for r in rows["encoding"].values())


def test_repeated_rows_and_rows_without_id_are_copies(spark):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(100))
    other = " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(100))
    rows = [(7, text, "en", "s", 1), (3, text + " x", "en", "s", 1), (3, text + " x", "en", "s", 1), (None, text, "en", "s", 1), (None, other, "en", "s", 1), (None, other, "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1)]
    got = p.near_copies(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame([rows[1], rows[4], rows[6], rows[7]], COLUMNS).collect()]))


def test_empty_tables(spark, tables, tmp_path):
    root = str(tmp_path)
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    assert p.run(spark, root).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_run_on_the_test_tables(spark):
    out = p.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"] and 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
