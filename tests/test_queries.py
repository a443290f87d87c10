"""Every registered query with SQL gives the rows of its SQL on the small tables."""

import os
import re

import duckdb
import pytest

from loomlake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.toPandas().astype(object).to_dict("records"))
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.execute(catalog.oracle_sql()[name]).df().astype(object)
    assert sorted(want.columns) == columns
    assert rows == sorted(repr([plain(r[c]) for c in columns]) for r in want.to_dict("records"))


def test_property_keys_come_from_whole_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.property_key for r in catalog.queries()["property_normalise"](spark, SF).collect()}
    assert got.keys() == texts.keys() and any(len(k) > 80 for k in got.values())
    for i, t in texts.items():
        for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("/", " ")):
            t = t.lower().replace(a, b)
        t = re.sub("[_-]+", " ", re.sub(r"[^a-z0-9\s_-]", "", t, flags=re.ASCII))
        assert got[i] == re.sub(r"\s+", " ", t, flags=re.ASCII).strip(" ")


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_imports_without_the_training_data_operators(tmp_path, pipeline):
    """With or without the pipeline beside the missing operators."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(catalog.queries())


def test_postings_are_made_in_one_pass_without_a_shuffle(spark, monkeypatch):
    """all postings were made twice, for a sample and for a shuffle."""
    from pyspark.sql import DataFrameWriter

    plans, given = [], DataFrameWriter.parquet

    def spy(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return given(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    assert catalog.queries()["keyword_topk_postings"](spark, SF).count() > 0
    assert len(plans) == 1 and "gram" in plans[0] and "Exchange" not in plans[0]
