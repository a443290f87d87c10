"""Bucketed deltas against a dictionary, with failures at each step, and committed appends."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.sources.delta import AppendLog, Commits, DeltaTable

SCHEMA = "key string, n int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def bytes_below(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def contents(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_one_changed_key_writes_one_bucket(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), "key", buckets=16)
    assert t.read() is None and t.commit(gone=frame(spark, []).select("key")) == -1
    rows = [(f"k{i}", i, f"text {i} " * 50) for i in range(1000)]
    t.commit(frame(spark, rows))
    whole = bytes_below(tmp_path / "t/rows")
    t.commit(frame(spark, [("k7", 7, "new"), ("k7", 8, "second row")]))
    added = tmp_path / "t/rows/delta_version=1"
    assert sum(n.startswith("delta_bucket=") for n in os.listdir(added)) == 1 and bytes_below(added) < whole / 50
    want = sorted([r for r in rows if r[0] != "k7"] + [("k7", 7, "new"), ("k7", 8, "second row")], key=repr)
    assert contents(t) == want and sorted(map(tuple, t.read(0).collect()), key=repr) == sorted(rows, key=repr)
    assert len(t.changed_buckets(0)) == 1 and len(t.changed_buckets(-1)) == 16 and t.changed_buckets(1) == []
    # buckets of one version are read without a join, and only the touched one is merged
    scans = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in scans and t.read(buckets=[b for b in range(16) if b not in t.changed_buckets(0)])._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert DeltaTable(spark, str(tmp_path / "t"), "key", buckets=999).buckets == 16


@pytest.mark.parametrize("seed", [1, 2])
def test_random_commits_and_compactions(spark, tmp_path, seed):
    rnd = random.Random(seed)
    t, state = DeltaTable(spark, str(tmp_path / "t"), "key", buckets=4, most_versions=3), {}
    for step in range(9):
        new = {rnd.choice([None, *"abcdefghij"]): [(rnd.randint(0, 9), "x" * rnd.randint(0, 3)) for _ in range(rnd.randint(1, 3))] for _ in range(rnd.randint(0, 4))}
        gone = [k for k in [None, *"abcdefghij"] if rnd.random() < 0.2 and k not in new]
        t.commit(frame(spark, [(k, *r) for k, rs in new.items() for r in rs]), spark.createDataFrame([(k,) for k in gone], "key string"), write_id=f"w{step}")
        for k in gone:
            state.pop(k, None)
        state.update(new)
        if step == 5:
            t.compact()
        assert contents(t) == sorted(((k, *r) for k, rs in state.items() for r in rs), key=repr)
    assert len(t.log.numbers()) <= Commits.KEPT
    before = t.version()
    assert t.commit(frame(spark, [("z", 1, "no")]), write_id="w8") == before and "z" not in {r.key for r in t.read().collect()}
    t.commit(frame(spark, [("only", 1, "x")]), whole=True)
    assert contents(t) == [("only", 1, "x")]
    t.commit(gone=t.read().select("key"))
    t.compact()
    assert t.read().count() == 0 and t.exists()


@pytest.mark.parametrize("step", ["rows", "keys", "publish"])
def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch, step):
    t = DeltaTable(spark, str(tmp_path / "t"), "key", buckets=4)
    t.commit(frame(spark, [("a", 1, "x"), ("b", 2, "y")]))
    before = contents(t)

    def broken(self, kind, number, rows, *more, own=DeltaTable._write):
        own(self, kind, number, rows, *more)
        if kind == step:
            raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "publish":
            m.setattr(Commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            m.setattr(DeltaTable, "_write", broken)
        with pytest.raises(OSError):
            t.commit(frame(spark, [("b", 3, "changed"), ("c", 4, "new")]), gone=frame(spark, [("a", 0, "")]))
    assert contents(t) == before
    t.commit(frame(spark, [("b", 3, "changed")]))  # takes the number of the failed one
    assert contents(t) == [("a", 1, "x"), ("b", 3, "changed")]


def test_a_second_writer_is_refused(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), "key", buckets=2)
    t.commit(frame(spark, [("a", 1, "x")]))
    with pytest.raises(RuntimeError):
        t.log.publish(0, {}, None)
    assert contents(t) == [("a", 1, "x")] and all(n.isdigit() or n.endswith(".crc") for n in t.log.names("commits"))


def test_clashing_names_and_new_columns(spark, tmp_path):
    t = DeltaTable(spark, str(tmp_path / "t"), "bucket", buckets=2)
    t.commit(spark.createDataFrame([("a", 1), ("b", 2)], "bucket string, version int"))
    t.commit(spark.createDataFrame([("b", 3, "x")], "bucket string, version int, more string"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1, None), ("b", 3, "x")]


def test_appends_count_once(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "l"), T.StructType.fromDDL("n long"), most_writes=4)
    assert log.read().count() == 0
    for i in range(7):
        assert log.append(spark.range(i, i + 2).select(F.col("id").alias("n")), f"w{i}")
        assert not log.append(spark.range(5).select(F.col("id").alias("n")), f"w{i}")
    assert sorted(r.n for r in log.read().collect()) == sorted(n for i in range(7) for n in (i, i + 1))
    assert len(log.log.last()[1]["writes"]) <= 4
