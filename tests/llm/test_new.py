"""Merge replay, fill-in-middle and resampling against the library, SQL and brute force, with awkward inputs."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlake.llm import decontaminate, fim, hashed, jaccard, langid, merge_replay, queries, resample

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
need_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SCHEMA = "doc_id long, text string, n string, rank string, ids string, n_tokens string, output string, place string"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (None, "no id here"), (None, None), (6, "Ünïcode 日本語 \U0001f600 <|endoftext|> <P>x"),
    (7, "word " * 60_000), (8, "x" * 50_000), (8, "x" * 50_000), (9, "a\x01b\x020\x021\x02 c"), (10, "<" * 40 + "S> P> M"), *((20 + i, "Some Words again " * 9 + "und Grüße") for i in range(12)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *"abcdef") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, name="documents"):
    return [(r[0], r.text or "") for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


# ---------------------------------------------------------------- 11


def library(name):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), public_tokenizers


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_merge_replay_equals_the_library(name):
    lib, public = library(name)
    own = merge_replay.load(public.path(name), public.PATTERN)
    rnd = random.Random(7)
    alphabet = [*"abs'dmtrelv 1 2.,!\n\t\r é日  \x1c\x85<|>ñß'\"-_", " ", "  ", "'ll", "\n\n", "<|endoftext|>", "́", "Ⅷ", "　", "the", "tion", "ing", "\U0001f600"]
    cases = ["", " ", "a" * 3000, "ab" * 3000, " " * 500 + "x", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(6000))]
    flat, at = own.encode_block(cases)
    for i, t in enumerate(cases):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == lib.encode_ordinary(t) and own.decode(ids) == t.encode(), t
    own.forget()
    assert own.encode("the same after forgetting") == lib.encode_ordinary("the same after forgetting")


def by_the_word(word: bytes, ids: dict[bytes, int]) -> list[int]:
    """Word by word: the lowest rank, then the leftmost pair."""
    if word in ids:
        return [ids[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while pairs := [(ids[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ids]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ids[p] for p in parts]


@pytest.mark.parametrize("few", [1, 24])
def test_merge_replay_of_ranks_in_any_order(tmp_path, monkeypatch, few):
    """Vocabularies whose ranks were never trained: a join may open a pair of a lower rank, and equal pairs overlap."""
    monkeypatch.setattr(merge_replay, "FEW", few)
    rnd, alone = random.Random(11), 0
    for round_ in range(25):
        longer = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))) for _ in range(40)})
        rnd.shuffle(longer)
        ids = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + longer)}
        path = tmp_path / f"{few}-{round_}.ranks"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in ids.items()))
        own = merge_replay.MergeReplay(str(path), "[a-c]+")
        single = own.replay_alone
        seen = []
        own.replay_alone = lambda w, single=single, seen=seen: (seen.append(w), single(w))[1]
        words = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14))) for _ in range(300)})
        flat, at = own.encode_block(words)
        for i, w in enumerate(words):
            assert flat[at[i] : at[i + 1]].tolist() == by_the_word(w.encode(), ids), (w, ids)
        alone += len(seen)
    assert alone  # the case does occur here


def test_merge_replay_refuses_a_vocabulary_without_all_bytes(tmp_path):
    (tmp_path / "x").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        merge_replay.MergeReplay(str(tmp_path / "x"), ".")


def test_merge_replay_of_awkward_rows(spark, odd, none):
    lib, public = library("byte_bpe_50k.tiktoken")
    path = public.path("byte_bpe_50k.tiktoken")
    out = merge_replay.encode(odd, path, public.PATTERN, decoded=True, digests=True)
    rows = out.collect()
    assert sorted(out.columns) == sorted({*odd.columns, "decoded", "ids_sha256", "decoded_sha256"}) and len(rows) == len(ODD)
    for r in rows:
        text = r.text or ""
        ids = lib.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes()) and r.decoded_sha256 == sha(text.encode())
    assert merge_replay.encode(none, path, public.PATTERN).count() == 0
    back = merge_replay.decode(out.select("doc_id", "ids", "text"), path, public.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    some = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in merge_replay.decode(some, path, public.PATTERN).collect()] == [None, b""]
    with pytest.raises(Exception, match="no token"):
        merge_replay.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), path, public.PATTERN).collect()


@need_data
def test_merge_replay_query(spark):
    lib, _ = library("byte_bpe_50k.tiktoken")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_merge_replay(spark, SF).collect()}
    want = {i: (len(ids := lib.encode_ordinary(t)), sha(np.array(ids, dtype="<u4").tobytes()), sha(t.encode())) for i, t in texts(spark)}
    assert got == want


# ---------------------------------------------------------------- 12


def split_middle(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_awkward_rows(spark, odd, none):
    rnd = random.Random(3)
    made = [(1000 + i, "".join(rnd.choice(["a", "bc", "\x01", "\x02", "0", "1", "é", "\U0001f600", "\n", " ", "<", "P", "S", ">"]) for _ in range(rnd.randint(0, 14)))) for i in range(1500)]
    frame = odd.unionByName(spark.createDataFrame([(*r, *"abcdef") for r in made], SCHEMA))
    out = fim.transform(frame)
    assert out.columns == [c for c in odd.columns if c not in ("n", "output")] + ["n", "form", "prefix", "middle", "suffix", "output"]
    rows = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(ODD) + len(made)
    for r in rows:
        assert (r.n, r.form, r.prefix, r.middle, r.output) == split_middle(r.doc_id, r.text or ""), r.doc_id
        assert r.back == (r.text or "") and r.rank == "b"
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(none).count() == 0


def test_fill_in_middle_stays_in_the_scan(spark, odd):
    plan = fim.transform(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@need_data
def test_fill_in_middle_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op12_fim(spark, SF)
    want = con.execute(queries.OP12_SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())


# ---------------------------------------------------------------- 13

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def runs_of(text: str) -> tuple[int, list[int]]:
    words = WORD.findall(text.encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn(docs: list[tuple[int | None, str]], target: list[str]) -> list[tuple]:
    found = [(i, *runs_of(t)) for i, t in docs]
    source, aim = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in runs_of(t)[1])
    s, t = sum(source.values()), sum(aim.values())
    gains = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in found:
        h = int(sha(f"42:{'' if i is None else i}".encode())[:8], 16)
        weight = sum(gains[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted(((r[0], *r[2:]) for r in rows), key=repr)


def test_features_of_texts_and_chunks():
    rnd = random.Random(2)
    for _ in range(200):
        many = ["".join(rnd.choice(["a", "B", "é", " ", ".", "1", "zz", "x" * rnd.choice([1, 3, 50, 300]), "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 6))]
        raw = [t.encode() for t in many]
        at = np.cumsum([0] + [len(r) for r in raw])
        buckets, of = resample.features(np.frombuffer(b"".join(raw), np.uint8), at, np.full(len(raw), -1))
        for i, t in enumerate(many):
            n, want = runs_of(t)
            assert sorted(buckets[of == i].tolist()) == sorted(want)
            pieces, words, size = Counter(), 0, rnd.choice([1, 5, 20, 100])
            for piece, own in resample.cut(raw[i], size):
                pieces += Counter(resample.features(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), np.array([own]))[0].tolist())
                words += own
            assert pieces == Counter(want) and words == n  # each run is owned by one chunk


@pytest.mark.parametrize("size", [16, resample.CHUNK_BYTES])
def test_resampling_of_awkward_rows(spark, odd, none, size):
    rnd = random.Random(9)
    made = [(100 + i, " ".join(rnd.choice("red green blue Ünd 7 long-word".split()) for _ in range(rnd.randint(15, 60)))) for i in range(150)]
    frame = odd.unionByName(spark.createDataFrame([(*r, *"abcdef") for r in made], SCHEMA))
    target = ["green blue blue", None, "", "7 red " * 40]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame, aims, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = drawn([(i, t or "") for i, t in ODD + made], [t or "" for t in target])
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[4] for r in want)
    assert resample.resample(none, aims, size=size).count() == 0
    lone = sorted(map(tuple, resample.resample(frame, aims.limit(0), size=size).collect()), key=repr)
    assert lone == drawn([(i, t or "") for i, t in ODD + made], [])


def test_one_document_repeated_is_ranked_row_by_row(spark):
    rows = [(1, "same words " * 20)] * 400 + [(2, "other words " * 20)] * 100
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string")).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 26)) and len(got) == 500


@need_data
def test_resampling_query(spark):
    got = queries.op13_resample(spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == drawn(texts(spark), [t for _, t in texts(spark, "benchmark")])


# ---------------------------------------------------------------- 2, 7


def test_every_language_is_learned(spark):
    """Two hundred labels, a third of all rows in one: the rare ones are learned as well."""
    rows = [(i, " ".join(f"w{k}x{j}" for j in range(6)), f"l{k}") for i, k in enumerate([*[0] * 1500, *(k for k in range(1, 200) for _ in range(15))])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=400)
    assert len(model.languages) == 200


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_do_not_depend_on_the_order_of_ids(spark, seed):
    """Near copies whose originals have no small ids, a template that half of the rows share, and a chain of links."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    template = " ".join(rnd.choice(words) for _ in range(12))
    rows = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(60)]
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            copy = list(base)
            copy[rnd.randrange(60)] = "changed"
            rows.append(" ".join(copy))
            base = copy if rnd.random() < 0.5 else base
    rows += [template + " " + " ".join(rnd.choice(words) for _ in range(6)) for _ in range(40)]
    ids = rnd.sample(range(10_000), len(rows))
    sets = []
    for t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 1 << 60), ids[i])
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string")).collect()}
    assert got == {ids[i]: least[root(i)] for i in range(len(rows))}


def test_label_shares_need_no_python_worker(spark):
    """pipeline: the shares went through an RDD, for which each executor kept a second daemon and its workers."""
    rows = spark.range(1000).selectExpr("id AS __id", "IF(id % 10 = 0, 'few', 'many') AS __label")
    sample = hashed.bounded_sample(rows, "__label", "__id", 400)
    plan = sample._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "ExistingRDD" not in plan
    n = {r["__label"]: r["count"] for r in sample.groupBy("__label").count().collect()}
    assert n["few"] == 100 and 150 <= n["many"] <= 250 and sample.columns == ["__id", "__label"]
    for kind in ("int", "double", "boolean", "date"):
        same = rows.selectExpr("__id", f"CAST({'__id % 2' if kind != 'date' else 'date_from_unix_date(int(__id % 2))'} AS {kind}) AS __label")
        assert hashed.bounded_sample(same, "__label", "__id", 2000).count() == 1000
    assert hashed.bounded_sample(rows.limit(0), "__label", "__id", 400).count() == 0


def test_batches_are_gathered_where_blocks_are_loaded_anew():
    batches = [pa.record_batch({"k": [i, None], "t": ["x" * 1000, None]}) for i in range(10)]
    out = list(decontaminate.gathered(iter(batches), 3000))
    assert len(out) == 4 and [k for b in out for k in b["k"].to_pylist()] == [k for i in range(10) for k in (i, None)]
    assert list(decontaminate.gathered(iter([]))) == []
