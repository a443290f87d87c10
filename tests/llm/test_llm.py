"""Training-data operators against brute force, round trips, held-out accuracy, and awkward inputs."""

import hashlib
import itertools
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

from loomlake.llm import bpe, chat, decontaminate, hashed, jaccard, langid, pii, quality, queries, suffix_tree, token_counts, toxicity
from loomlake.llm.common import TextBatch, fold_of, stored

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
need_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, spans string, n_tokens string, component_id string"
LONG = "word " * 60_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", "en", None, 3), (4, "one", "en", "s", 3), (5, "one", "en", "s", 3), (None, "no id here", "en", "s", 3),
    (6, "Ünïcode 日本語 \U0001f600 <|endoftext|> mail a.b@c.de, +1 (456) 555-2186", "de", "s", 9), (7, LONG, "en", "s", len(LONG)), (8, "x" * 50_000, None, "s", 1), (8, "x" * 50_000, None, "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *"abcde") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---------------------------------------------------------------- 1


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, lib = bpe.load(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    rnd = random.Random(5)
    alphabet = [*"abs'dmtrelv 1 2.,!\n\t\r é日  \x1c\x85<|>ñß'\"-_", " ", "  ", "'ll", "\n\n", "<|endoftext|>"]
    cases = ["", " ", "it's 'sé", "a" * 3000, " " * 500 + "x", *("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(4000))]
    for t in cases:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_forced_cuts_never_lie_inside_a_token():
    own = bpe.load(queries.vocabulary())
    assert own.cuts.any()
    assert all(not len(own.cut_points(np.frombuffer(t, np.uint8))) for t in own.ids)


def test_bpe_query_on_odd_rows(odd, none):
    rows = bpe.encode(odd, queries.vocabulary(), digests=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.decoded == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(odd, queries.vocabulary(), keep=["doc_id"], decoded=False), queries.vocabulary()).collect()}[6] == ODD[6][1]
    assert bpe.encode(none, queries.vocabulary()).count() == 0


@need_data
def test_bpe_query_equals_the_library_on_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: r for r in queries.op1_bpe(spark, SF).collect()}
    rows = texts(spark)
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---------------------------------------------------------------- 2, 4, 10


@need_data
def test_toxicity_query_on_held_out_rows(spark):
    """Learned from one part of the labels, the query tells the other part's classes apart."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = queries.op4_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [p for y, p in held if y], [p for y, p in held if not y]
    print("held-out recall", sum(bad), len(bad), "specificity", sum(1 - p for p in good), len(good))
    assert sum(bad) >= 0.6 * len(bad) and sum(1 - p for p in good) >= 0.8 * len(good)


@need_data
def test_language_held_out(spark, docs):
    rows = queries.op2_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(odd, none):
    model = langid.train(odd)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert got[4].lang_pred in ("de", "en")
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_samples_are_bounded(spark):
    """Half of the ids null, one id repeated 10,000 times, contradicting labels: a bounded sample, the same on any partitioning."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, None).when(F.col("id") < 20_000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("some text "), F.col("id") % 50, F.lit(" more")).alias("text"), F.element_at(F.array(F.lit("de"), F.lit("en")), (F.col("id") % 3 % 2 + 1).cast("int")).alias("lang"))
    got = []
    for n in (1, 5):
        model = langid.train(rows.repartition(n), rows=200)
        got.append(model.weights)
        sample = hashed.one_text(hashed.bounded_sample(rows.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("lang").alias("__label")), "__label", "__id", 200))
        assert 20 < sample.count() < 400 and sample.where("__id is null").count() == 0 and sample.where("__id = 7").count() <= 2
    assert np.array_equal(*got)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert sorted(map(tuple, hashed.agreed_labels(labels, "doc_id", "toxic").collect())) == [(2, 1), (4, 0)]
    assert toxicity.train(rows, labels.unionByName(rows.select("doc_id", F.lit(1).alias("toxic")))).trained is False  # no text has label 0


@pytest.mark.parametrize("text,want", [("²", False), ("½ 3", False), ("_١٢", False), ("é", True), ("1a", True), ("日", True)])
def test_letters(text, want):
    assert langid.has_letter(text.encode()) is want


def test_families_split_into_pairs():
    rng = np.random.default_rng(0)
    x = np.zeros((80, langid.FEATURES.size), dtype=np.float32)
    x[:, 100:110] = rng.random((80, 10)) * 0.01
    labels = ["de", "en", "fr", "es"] * 20
    for i, v in enumerate(labels):
        x[i, ["de", "en", "fr", "es"].index(v)] += 1
    model = langid.fit(x, labels)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    best, score = model.predict(x @ model.weights + model.bias)
    assert [model.languages[b] for b in best] == labels and (score > 0.5).all()


@need_data
def test_toxicity_learns_words_and_prefixes():
    rng = np.random.default_rng(1)
    filler = ["".join(rng.choice(list("aeiourst"), 6)) for _ in range(3000)]
    rows, y = [], []
    for i in range(600):
        words = list(rng.choice(filler, 60))
        if bad := i % 3 == 0:
            words[int(rng.integers(60))] = "grumble" + "".join(rng.choice(list("xyzw"), 3))
        rows.append(" ".join(words))
        y.append(int(bad))
    hashes = []
    for run in TextBatch(pa.array(rows)).runs():
        h, first = toxicity.word_hashes(run)
        hashes += [h[a:b] for a, b in zip(first, first[1:])]
    model = toxicity.fit(hashes[:450], np.array(y[:450]), np.full(450, len(toxicity.GROUPS) - 1))
    score = np.concatenate([model.scores(r) for r in TextBatch(pa.array(rows[450:])).runs()])
    assert ((score >= 0.5) == np.array(y[450:])).mean() > 0.97


def test_toxicity_learns_pairs_of_words():
    """Both words are in every text and side by side only in the bad ones: no single word and no untrained network tells them apart."""
    rng = np.random.default_rng(1)
    filler = ["".join(rng.choice(list("aeioursmn"), 6)) for _ in range(800)]
    rows, y = [], []
    for i in range(900):
        words = list(rng.choice(filler, 40))
        at = int(rng.integers(2, 36))
        if i % 3 == 0:
            words[at:at] = ["grumble", "snarl"]
        else:
            words.insert(at, "grumble")
            words.insert(int(rng.integers(0, at - 1)), "snarl")
        rows.append(" ".join(words))
        y.append(int(i % 3 == 0))
    y, hashes = np.array(y), []
    for run in TextBatch(pa.array(rows)).runs():
        h, first = toxicity.word_hashes(run)
        hashes += [h[a:b] for a, b in zip(first, first[1:])]

    def balanced(passes):
        model = toxicity.fit(hashes[:600], y[:600], np.full(600, len(toxicity.GROUPS) - 1), passes=passes)
        said = np.concatenate([model.scores(r) for r in TextBatch(pa.array(rows[600:])).runs()]) >= 0.5
        return (said[y[600:] == 1].mean() + (~said[y[600:] == 0]).mean()) / 2

    assert balanced(0) < 0.7 and balanced(toxicity.PASSES) > 0.95


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (7, 1), (8, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    for model in (toxicity.train(odd, labels), toxicity.train(odd, labels.where("toxic = 5")), toxicity.train(none, labels)):
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert toxicity.score(none, model).count() == 0


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_quality_measures_by_brute_force(spark, odd, none):
    rnd = random.Random(2)
    more = [(100 + i, "".join(rnd.choice(["a ", "b ", "ab c ", "\n", "é#", " \x0b", "| ", "a b c\n", "\x1c", " "]) for _ in range(rnd.randint(0, 150)))) for i in range(300)]
    rows = spark.createDataFrame([(r[0], r[1]) for r in ODD if r[0] not in (7,)] + more, "doc_id long, text string")
    model = quality.fit(np.zeros((0, quality.FEATURES.size), np.float32), np.array([]))
    for r in quality.apply(rows, model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text), r.text
        assert r.kept is (not r.base_failed)
    assert quality.apply(odd, model).count() == len(ODD) and quality.apply(none, model).count() == 0


@need_data
def test_quality_separates_labelled_rows(spark, docs):
    rows = queries.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed AND quality IS NOT NULL").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.97 * len(rows)


# ---------------------------------------------------------------- 3


@need_data
def test_base_score_by_brute_force_and_model_beats_it(spark):
    got = {r.doc_id: r for r in queries.op3_lm(spark, SF).collect()}
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)), ""]
    counts = Counter()
    rows = texts(spark)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tok(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        own = tok(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-9, 1, 50), np.linspace(1, 1e4, 50)])
    assert suffix_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-8, rel=1e-9)


def test_lm_odd_rows(spark, odd, none):
    rows = suffix_tree.score(odd, F.col("doc_id") != 7).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[1] == 1
    assert suffix_tree.score(none, F.lit(True)).count() == 0
    assert suffix_tree.score(odd, F.lit(False)).where("n_known > 0").count() == 0
    named = odd.select(F.col("doc_id").alias("block"), "text", F.lit(1).alias("part"))
    assert suffix_tree.score(named, F.lit(None).cast("boolean"), key="block").columns[0] == "block"


def lm_tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) + [None]


class BruteTree:
    """The suffix tree as plain dictionaries."""

    def __init__(self, texts):
        strength, depth = suffix_tree.STRENGTH, suffix_tree.DEPTH
        self.seen = [Counter() for _ in range(depth + 1)]
        for t in texts:
            for g in self.steps(t):
                for k in range(depth + 1):
                    if len(g) > k:
                        self.seen[k][g[-k - 1 :]] += 1
        self.total, self.once = sum(self.seen[0].values()), sum(c == 1 for c in self.seen[0].values())
        self.n = [Counter() for _ in range(depth + 1)]
        for k in range(depth + 1):
            for g, c in self.seen[k].items():
                self.n[k][g[:-1]] += c
        self.kept, self.open = [set() for _ in range(depth + 1)], 0
        self.repeated = [Counter() for _ in range(depth + 1)]
        for k in range(1, depth + 1):
            gains = {}
            for g, c in self.seen[k].items():
                if c > 1:
                    q = self.seen[k - 1][g[1:]] / self.n[k - 1][g[1:-1]]
                    gains[g[:-1]] = gains.get(g[:-1], 0) + math.lgamma(strength * q + c) - math.lgamma(strength * q) - c * math.log(q)
                    self.repeated[k][g[:-1]] += c
            for x, v in gains.items():
                n, m = self.n[k][x], self.repeated[k][x]
                if v + (n - m) * math.log(strength) + math.lgamma(strength) - math.lgamma(strength + n) >= suffix_tree.GAIN:
                    self.kept[k].add(x)
            self.open += sum(v > 1 for v in self.n[k].values())

    @staticmethod
    def steps(t):
        """Each token with up to DEPTH symbols before it, of which one at most is before the text."""
        s = ["<", *lm_tokens(t)]
        return [tuple(s[max(0, j - suffix_tree.DEPTH) : j + 1]) for j in range(1, len(s))]

    def p(self, g, depth=suffix_tree.DEPTH):
        unknown = (self.once + 1) / (self.total + self.once + 1)
        c = self.seen[0][g[-1:]]
        out = (1 - unknown) * c / self.total if c else unknown
        for k in range(1, min(depth, len(g) - 1) + 1):
            x = g[-k - 1 : -1]
            if x in self.kept[k]:
                c, n, m = self.seen[k][g[-k - 1 :]], self.n[k][x], self.repeated[k][x]
                out = ((c if c > 1 else 0) + (suffix_tree.STRENGTH + n - m) * out) / (n + suffix_tree.STRENGTH)
        return out


def test_lm_equals_brute_force_and_keeps_contexts_of_any_share(spark, monkeypatch):
    """A context of 8 tokens among a million, and words outside the most frequent ones, count as they do in a small table."""
    rnd = random.Random(4)
    words = [f"w{k}x{k % 7}" for k in range(60)]
    rows = [(i, " ".join(rnd.choices(words[i % 3 * 15 :][:30], k=rnd.randint(1, 40)))) for i in range(60)]
    rows += [(100 + i, "zq xk then one") for i in range(8)] + [(200 + i, "aq xk") for i in range(2)]
    held = {0, 1, 2, 7, 300, 301}
    rows += [(300, "zq xk then unseen"), (301, "aq nothing w1x1"), (302, ""), (303, "Twice said TWICE said twice said")]
    rows += [(500 + i, f"{('left', 'right')[i % 2]} mid {('one', 'two')[i % 2]} {('up', 'down')[i // 2 % 2]} so then {('high', 'low')[i // 2 % 2]}") for i in range(24)]
    rows.append((400, "a b c d " * 250_000))
    tree = BruteTree(t for i, t in rows if i not in held)
    assert ("zq",) in tree.kept[1] and ("left", "mid") in tree.kept[2] and ("up", "so", "then") in tree.kept[3]
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 500)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r.score for r in suffix_tree.score(frame, ~F.col("doc_id").isin(*held)).collect()}
    want = {i: sum(math.log10(tree.p(g)) for g in tree.steps(t)) for i, t in rows}
    assert got == pytest.approx(want)
    for x in [("<",), ("zq",), ("aq", "xk"), ("<", "zq", "xk"), ("b", "c", "d"), ("none",)]:  # known words and unknown are a distribution
        assert sum(tree.p((*x, s)) for s in [*(g[0] for g in tree.seen[0]), "unseen"]) == pytest.approx(1)


@need_data
def test_lm_contexts_tell_and_shuffled_words_do_not(spark):
    rows = texts(spark)[:400]
    train, held = [t for i, t in rows if i % 5], [t for i, t in rows if not i % 5]
    tree = BruteTree(train)
    flat = [w for t in train for w in lm_tokens(t)[:-1]]
    random.Random(1).shuffle(flat)
    shuffled, at = [], 0
    for t in train:
        n = len(lm_tokens(t)) - 1
        shuffled.append(" ".join(flat[at : at + n]))
        at += n
    noise = BruteTree(shuffled)
    assert sum(map(len, noise.kept)) < 0.05 * noise.open < sum(map(len, tree.kept))
    steps = [g for t in held for g in tree.steps(t) if tree.seen[0][g[-1:]]]
    known = [sum(math.log10(tree.p(g, k)) for g in steps) / len(steps) for k in range(4)]
    assert known[0] + 0.02 < known[1] and known[1] <= known[3]
    again = held[:20]
    twice = BruteTree(train + again + again)
    rate = lambda tree, ts: sum(math.log10(tree.p(g)) for t in ts for g in tree.steps(t)) / sum(len(lm_tokens(t)) for t in ts)
    assert rate(twice, again) > rate(BruteTree(train + again), again) + 0.2


# ---------------------------------------------------------------- 5


def brute_pii(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_patterns_by_brute_force():
    rnd = random.Random(3)
    parts = [*"ab1290.-+@ ()%\né", "1.2.3.4", "4111111111111111", "+1 (456) 555-2186", "x@y.z", "9999999999"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_field_adds_what_patterns_miss():
    t = "call +1 (269) 555-3296 4524132264652876 now, or write to anna (at) mail (dot) com today"
    base, spans = (x[0] for x in pii.find([t]))
    assert base == [] and {s[2] for s in spans} >= {"phone", "card", "email"}
    assert "4524" not in pii.redact(t, spans) and "now, or write" in pii.redact(t, spans)
    assert pii.find(["Version 2.0. and page 12 of 99, key=1db2aa3fcc9 in 2024"])[1] == [[]]


@pytest.mark.parametrize("between", range(10))
@pytest.mark.parametrize("first", ["555-123-4567", "a [at] b.com", "page 12", "x@y.org"])
def test_pii_stretches_keep_a_name_with_its_address(first, between):
    t = " ".join(["call", first, *["then"] * between, "anna", "[at]", "host", "[dot]", "com", "and", "so", "on"])
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    runs = [[(a, b) for _, a, b in s] for s in pii.stretches(t)]
    assert sum(runs, []) == sorted(set(sum(runs, [])))
    for i, (a, b) in enumerate(words):
        if re.search(r"[0-9@]|\[at\]", t[a:b]):
            assert any(set(words[max(0, i - pii.REACH) : i + pii.REACH + 1]) <= set(r) for r in runs), (a, runs)
    if (first, between) != ("x@y.org", 0):  # there the field's span touches the base span before it and is dropped
        assert "anna" not in pii.redact(t, pii.find([t])[1][0])


def test_field_viterbi_is_the_best_path():
    crf = pii.trained()
    words = ["call", "555-123-4567", "now"]
    e = crf.emissions([crf.rows(words)])[0]
    step, first = crf.step + crf.allowed, crf.first + crf.start
    best = max(itertools.product(range(len(pii.TAGS)), repeat=3), key=lambda p: first[p[0]] + e[0][p[0]] + step[p[0], p[1]] + e[1][p[1]] + step[p[1], p[2]] + e[2][p[2]])
    assert tuple(crf.viterbi(e[None])[0][0]) == best


def test_pii_odd_rows(odd, none):
    rows = {r.doc_id: r for r in pii.detect(odd, redacted="clean").collect()}
    assert rows[1].clean is None and rows[1].spans == "" and rows[6].n_email == 1 and rows[6].n_phone == 1 and "[email]" in rows[6].clean
    assert pii.detect(none).count() == 0


# ---------------------------------------------------------------- 6


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 15))
        score, first, last = decontaminate.smith_waterman(a.astype(np.uint64), b.astype(np.uint64))
        assert score == brute_align(a.tolist(), b.tolist())
        if score:
            assert brute_align(a.tolist(), b[first : last + 1].tolist()) == score


def test_leaks_of_copied_and_edited_items(spark, none):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(30)] for _ in range(3)]
    edited = [w if i % 6 else word() for i, w in enumerate(items[1])]
    pad = lambda ws: " ".join([word() for _ in range(80)] + ws + [word() for _ in range(80)])
    rows = [(1, pad(items[0])), (2, pad([w.upper() + "," for w in edited])), (3, pad([])), (4, None), (5, ""), (6, pad(items[2][:5])), (7, pad(items[0] + items[2])), (8, "tiny one")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(3, None), (4, "tiny one"), (None, "")], "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 1), (7, 0), (7, 2), (8, 4)]
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.scan(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_recall_against_full_alignment(spark, monkeypatch):
    """Edited copies among frequent words: the seeds find what aligning every item with every document finds."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    weights = [1 / (k + 3) for k in range(3000)]
    draw = lambda n: rnd.choices(words, weights, k=n)
    items = [draw(rnd.choice([8, 12, 30])) for _ in range(60)] + [words[:8], words[3:9]]  # the last two are of common words only
    docs = []
    for i in range(240):
        own = draw(120)
        if i % 2:
            item = items[i // 2 % len(items)]
            rate = (0, 0.15, 0.25)[i % 3]
            own[40:40] = [w for w in (rnd.choice(words) if rnd.random() < rate else w for w in item) if rnd.random() > rate / 3]
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several blocks
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    hashed, own = decontaminate.item_words([t for _, t in docs]), decontaminate.item_words([" ".join(w) for w in items])
    want = {(d, i): s for d, h in enumerate(hashed) for i, w in enumerate(own) if (s := decontaminate.smith_waterman(w, h)[0] / (2 * len(w))) >= decontaminate.LEAK_AT}
    planted = {(i, i // 2 % len(items)) for i in range(1, 240, 2)} & set(want)
    assert set(got) <= set(want) and all(got[k] <= want[k] + 1e-9 for k in got)
    assert len(planted & set(got)) >= 0.95 * len(planted) and len(planted) > 100


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word word word word"), (1, "word word word word"), (2, "x" * 50_000), (None, "no id here")], "item_id long, text string")
    rows = decontaminate.scan(odd.withColumn("leaks", F.lit(1)), bench).collect()
    assert len(rows) == len(ODD)
    hits = [(r.doc_id, [m.item_id for m in r.leaks]) for r in rows if r.leaks]
    assert sorted(hits, key=str) == sorted([(7, [1, 1]), (8, [2]), (8, [2]), (None, [None])], key=str)
    assert decontaminate.scan(none, bench).count() == 0


# ---------------------------------------------------------------- 7


def brute_classes(rows, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (1, 50)])
def test_classes_by_brute_force(spark, size, percent):
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    bases = [[word() for _ in range(rnd.choice([3, 30, 60, 61, 120]))] for _ in range(8)]
    passage = [word() for _ in range(50)]
    rows = [(1000, None), (1001, " \n"), (1002, "A b"), (1003, "a  B\n")]
    for i in range(160):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = word()
        if i % 7 == 0:
            w = w[: rnd.randint(1, 40)] + passage
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
    assert got == brute_classes(rows, size, percent)


def test_classes_odd_rows(odd, none):
    rows = jaccard.classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id: r.n_shingles for r in rows}[1] == 0 and jaccard.classes(none).count() == 0


# ---------------------------------------------------------------- 8, 9


def change(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], token_counts.CHANGES)


def test_rollups_follow_every_change(spark, tmp_path):
    t = token_counts.TokenCounts(spark, str(tmp_path / "r"))
    assert t.totals().count() == 0
    assert t.commit(1, change(spark, [("insert", 1, "s", "en", "v1", 10), ("insert", 2, "s", "en", "v1", 5), ("insert", 3, None, None, "v1", 7), ("insert", None, "s", "en", "v1", 9), ("insert", 2, "s", "en", "v1", 6)]))
    second = change(spark, [("revise", 1, "t", "en", "v1", 11), ("delete", 3, None, None, "v1", None), ("delete", 9, "s", "en", "v1", 1), ("insert", 1, "s", "en", "v2", 3)])
    assert t.commit(2, second) and not t.commit(2, second)
    with pytest.raises(ValueError):
        t.commit(0, second)
    assert sorted(map(tuple, t.totals().collect())) == [("s", "en", "v1", 1, 6), ("s", "en", "v2", 1, 3), ("t", "en", "v1", 1, 11)]
    # a batch that was written but not committed is written anew
    t._fs.delete(t._path(f"{t.root}/commits/2"), False)
    assert ("s", "en", "v1", 2, 16) in set(map(tuple, t.totals().collect()))
    assert t.commit(2, second) and ("t", "en", "v1", 1, 11) in set(map(tuple, t.totals().collect()))


def test_rollups_of_empty_batches_and_compacted_ledgers(spark, tmp_path):
    t = token_counts.TokenCounts(spark, str(tmp_path / "r"))
    t.compact()
    assert t.commit(1, change(spark, [])) and t.totals().count() == 0
    t.commit(2, change(spark, [("insert", i, "s", "en", "v1", i) for i in range(1, 6)]))
    t.compact()
    t.compact()
    t.commit(3, change(spark, [("delete", 1, None, None, "v1", None), ("revise", 2, "s", "de", "v1", 20)]))
    for _ in range(2):
        assert sorted(map(tuple, t.totals().collect())) == [("s", "de", "v1", 1, 20), ("s", "en", "v1", 3, 12)]
        assert sorted((r.doc_id, r.n_tokens) for r in t.ledger().collect()) == [(2, 20), (3, 3), (4, 4), (5, 5)]
        t.compact()


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<<||>>", "a\n<|im_start|>assistant\nb", "日本語 <|é|>", "\\n"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_reads_back(spark, none):
    rows = [(1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "user", None), (1, 2, None, "x"), (1, 2, "assistant", "same turn"), (None, 0, "assistant", "no conversation"), (2, None, "system", "s"), (3, 0, "assistant", "long " * 200_000)]
    rows.append((None, 0, "assistant", "no conversation"))
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.vocabulary()).collect()
    got = {r.conv_id: chat.parse(np.array(r.input_ids, dtype=np.int32), np.array(r.loss_mask), queries.vocabulary()) for r in out}
    assert got[1] == ([("user", ""), ("assistant", rows[0][3]), ("", "x"), ("assistant", "same turn")], rows[0][3] + "same turn")
    assert got[None][1] == "no conversation" and got[2] == ([("system", "s")], "")
    assert got[3][1] == rows[6][3] and sum(r.conv_id is None for r in out) == 2
    formatted = {r.conv_id: r.formatted for r in out}
    assert formatted[2] == "<|im_start|>system\ns<|im_end|>\n"
    assert formatted[1].startswith("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n" + chat.escape(rows[0][3]) + "<|im_end|>\n")
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), queries.vocabulary()).count() == 0


@need_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name]).df()
    key = lambda frame: sorted(map(repr, frame[columns].astype(object).values.tolist()))
    assert key(got.toPandas()) == key(want)


def test_folds(spark):
    rows = spark.createDataFrame([(1,), (25,), (None,)], "doc_id long").select("doc_id", fold_of(F.col("doc_id")).alias("f")).collect()
    assert [r.f for r in rows] == [zlib.crc32(b"1") % 5, zlib.crc32(b"25") % 5, -1]
