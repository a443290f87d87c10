"""Exact Jaccard self-join of documents on word shingles, by a token-group matrix.

A document is the set of its distinct shingles of SHINGLE words (A-Z lower-
cased, words [^\\x20\\x09-\\x0D]+; with fewer words, the whole sequence is its
one shingle).  Two documents link when 100 * |A n B| >= percent * |A u B|.

1. *Equal sets* become one node (grouped by a 128-bit signature), so copies cost
   nothing further however many there are.
2. *Probe tokens.*  All nodes order their shingles in one way: shingles that many
   documents have come last, then by hash.  Of two sets that link, the first
   |A| - ceil(t|A|) + 1 shingles of each share one at least, so only these are
   indexed.  The order affects work, never results.
3. *Size groups.*  The coarse level of the matrix: nodes are grouped by size, and
   a node counts its probe tokens in each size group's union.  Nodes for which no
   group reaches the bound of step 5 can link with nothing and leave the index.
4. *Groups.*  In each token's bucket every node points at the bucket's LEADERS
   smallest nodes.  Pairs that meet in enough buckets are compared exactly, and
   the components of the links are the groups of similar documents.
5. *Matrix.*  For each group the union of its members' probe tokens is kept as
   rows (token, group).  A query counts its probe tokens in each other group's
   union; that count bounds the overlap with any member (see ``least_shared``).
   Groups under the bound stay closed; members of the others are compared
   exactly.  Each pair of groups is queried from one side, and a query that needs
   r of its k indexed tokens in a group finds it by its k - r + 1 rarest ones.
6. The components of all links found are the classes.

A hot shingle's bucket is never expanded into pairs: step 4 makes LEADERS pairs
for each node, step 5 one for each node and group.  Links and components stay
distributed; only the bounded list of frequent shingles reaches the driver.

Null, empty and blank texts have no shingles and link with nothing; their class
is their own id.  Rows of the same id count as one document when linking.  Rows
with a null id are returned with a null class and link with nothing.  Shingles
are 64-bit hashes: two different shingles of a pair of documents are taken for
one with a probability of about |A| |B| / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import FOLD, Run, Scratch, TextBatch, map_batches, mix, stored
from loomlake.llm.decontaminate import Lookup, gram_keys
from loomlake.runtime import ensure_package

SHINGLE, PERCENT = 4, 85
#: Frequent shingles that are ordered last: at most so many, each counted so often at least.  Bounds the broadcast; affects no result.
FREQUENT_LIMIT, FREQUENT_AT = 1 << 20, 8
#: Ratio of sizes within a size group.
SIZE_STEP = 1.03
#: Nodes of a bucket that its other nodes are compared with to form groups.
LEADERS = 4
#: Tasks over which the members of one group are dealt.
SALTS = 32
#: Members of a group that are read together.
BLOCK_MEMBERS = 64
#: Shingles after which a task's local counts are reduced to those seen LOCAL_AT times.
LOCAL_SHINGLES, LOCAL_AT = 2 << 20, 3
#: Nodes whose ids may be broadcast to fetch their texts; beyond that the fetch is a shuffle join.
BROADCAST_IDS = 1 << 20


def shingle_sets(run: Run, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a run."""
    data = FOLD[run.data]
    starts, stops, first = run.words(data)
    hashes = run.word_hashes(starts, stops, data)
    keys = gram_keys(hashes, size)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(keys[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:  # shorter sequences of different lengths never share a key with whole shingles
            out.append(mix(gram_keys(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def probe_length(n: int, percent: int) -> int:
    """Shingles of a set of n that must be indexed."""
    return n - ceil(percent * n / 100) + 1


def probe_tokens(s: np.ndarray, frequent: Lookup, percent: int) -> np.ndarray:
    late = np.zeros(len(s), dtype=bool)
    late[frequent.find(s)[0]] = True
    return np.concatenate((s[~late], s[late]))[: probe_length(len(s), percent)]


def least_shared(n: Column, other: Column, percent: int) -> Column:
    """Probe tokens that sets of sizes n and other share at least when they link.

    Let v be the earlier of the two last probe tokens.  All shingles up to v of
    both sets are probe tokens, so with c of them shared and a of the first set's
    up to v, the overlap is at most c + n - a; it must reach
    need = ceil(percent * (n + other) / (100 + percent)).  For the set whose last
    probe token is v, a is its probe length, hence c >= 1 + need - ceil(percent * n / 100)
    for that set, and in any case for the larger one.
    """
    need = F.ceil((n + other) * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    return F.greatest(F.lit(1), need + 1 - F.ceil(F.greatest(n, other) * percent / F.lit(100.0) - F.lit(1e-9)))


def qualifies(shared: Column, n: Column, low: Column, high: Column, percent: int) -> Column:
    """Whether a set of size n with so many probe tokens in a group's union may link with a member of size low to high.

    The bound is least at the ends of the member sizes that can link; one less for rounding between them.
    """
    smallest = F.greatest(low, F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)))
    largest = F.least(high, F.floor(n * F.lit(100.0) / percent + F.lit(1e-9)))
    return (smallest <= largest) & (shared >= bound(n, smallest, largest, percent))


def bound(n: Column, smallest: Column, largest: Column, percent: int) -> Column:
    return F.least(least_shared(n, smallest, percent), least_shared(n, largest, percent)) - 1


def shared_only(index: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (token, node, n, k) whose token k > 1 nodes have.

    Counts are summed in the tasks first and stored, so that the join has a shuffle of its own on either side and
    Spark splits a hot token's rows.
    """
    counts = scratch.store(index.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "counts")
    return index.join(counts, "token").select("token", "node", "n", "k")


def can_link(index: DataFrame, percent: int) -> DataFrame:
    """The index without the nodes that share too few probe tokens with every size group.

    Adds ``need``: the fewest probe tokens that a node shares with anything it links with.
    """
    c = F.col
    sized = index.withColumn("size", F.floor(F.log(c("n")) / F.log(F.lit(SIZE_STEP))))
    matrix = sized.groupBy("token", "size").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"))
    seen = sized.withColumnRenamed("size", "own").join(matrix, "token").where(((c("own") != c("size")) | (c("m") > 1)) & (c("n") * 100 >= c("low") * percent) & (c("high") * 100 >= c("n") * percent))
    seen = seen.groupBy("node", "size").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    smallest = F.greatest("low", F.ceil(c("n") * percent / F.lit(100.0) - F.lit(1e-9)))
    largest = F.least("high", F.floor(c("n") * F.lit(100.0) / percent + F.lit(1e-9)))
    need = seen.where(qualifies(c("c"), c("n"), c("low"), c("high"), percent)).groupBy("node").agg(F.greatest(F.lit(1), F.min(bound(c("n"), smallest, largest, percent))).alias("need"))
    return index.drop("need").join(need, "node")


def leaders(index: DataFrame) -> DataFrame:
    """(token, leaders): the LEADERS smallest nodes of each bucket that has two or more. Tasks send so many rows of a bucket on at most."""
    place = F.row_number().over(W.partitionBy("token").orderBy("node"))
    first = index.select("token", "node", "n").withColumn("place", place).where(F.col("place") <= LEADERS)
    return first.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("leaders")).where(F.size("leaders") > 1)


def measured(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Rows of two kinds: (id, n, sig_a, sig_b) for documents and (token, n) for locally frequent shingles."""
    schema = "kind tinyint, id bigint, n bigint, sig_a bigint, sig_b bigint"
    names = ["kind", "id", "n", "sig_a", "sig_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts >= LOCAL_AT], counts[counts >= LOCAL_AT]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int8)), pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64)), none, none], names=names)

        for batch in batches:
            ns, sa, sb = [], [], []
            for r in TextBatch(batch.column(1)).runs():
                for s in shingle_sets(r, size):
                    ns.append(len(s))
                    a, b = signature(s)
                    sa.append(a)
                    sb.append(b)
                    held.append(s)
                    total += len(s)
                if total >= LOCAL_SHINGLES:
                    yield frequent()
                    held, total = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int8)), batch.column(0), pa.array(ns, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64())], names=names)
        if held:
            yield frequent()

    return map_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), run, schema)


def probes(docs: DataFrame, key: str, text: str, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(id, n, tokens): the probe tokens of every document with shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            texts = TextBatch(batch.column(1))
            ids, ns, tokens = [], [], []
            given = batch.column(0).to_pylist()
            for r in texts.runs():
                for i, s in enumerate(shingle_sets(r, size)):
                    if len(s):
                        ids.append(given[r.first + i])
                        ns.append(len(s))
                        tokens.append(probe_tokens(s, lookup, percent).view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "tokens"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_batches(rows, run, "id bigint, n bigint, tokens array<bigint>")


def texts_of(docs: DataFrame, key: str, text: str, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, text) of the documents with the given ids, without moving other texts where the ids are few."""
    ids = scratch.store(ids.distinct(), f"ids-{name}")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link. A hot b is a skewed join, which Spark splits."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), dtype=bool)
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = [[s for r in TextBatch(part.column(k)).runs() for s in shingle_sets(r, size)] for k in (2, 3)]
                for i, (x, y) in enumerate(zip(*sets)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    hit[lo + i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node of its component.

    Alternates large-star and small-star steps; every step is a grouped minimum and a
    join, and its result is a written table, so a lost executor costs one step.  The
    minima are written too: a join of two tables has a shuffle of its own on either
    side, and Spark splits the links of a hot node.
    """

    c = F.col
    step = 0
    state = scratch.store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    while True:
        # done when every node points at one root and no root points on
        roles = state.select(c("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(state.select(c("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        roles = roles.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not roles.where("below > 1 OR (below > 0 AND above > 0)").limit(1).count():
            return state.select(c("u").alias("node"), c("v").alias("label")).unionByName(state.select(c("v").alias("node"), c("v").alias("label")).distinct())
        both = state.unionByName(state.select(c("v").alias("u"), c("u").alias("v")))
        low = scratch.store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low-{step}")
        large = scratch.store(both.join(low, "u").where("v > u").select(c("v").alias("u"), c("m").alias("v")).where("u <> v"), f"{name}-large-{step}")
        least = scratch.store(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least-{step}")
        small = large.join(least, "u").select("v", "m").unionByName(least.select(c("u").alias("v"), "m"))
        state = scratch.store(small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct(), f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", *(f"{name}-{k}-{step}" for k in ("low", "large", "least")))
        step += 1


def link_nodes(index: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, label) of the nodes that link with another, from the shared probe tokens (token, node, n, k, need, leaders)."""
    compatible = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    c = F.col
    # 4. groups: a pair for each node and leader of a bucket
    stars = index.select("node", "n", F.explode(F.filter("leaders", lambda x: x["node"] < c("node"))).alias("leader"))
    stars = stars.groupBy(c("node").alias("a"), c("leader.node").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("leader.n").alias("m"))
    stars = stars.where(compatible(c("n"), c("m")) & (c("c") >= least_shared(c("n"), c("m"), percent))).select("a", "b")
    stars = scratch.store(stars, "stars")
    texts = texts_of(docs, key, text, stars.select(c("a").alias("id")).unionByName(stars.select(c("b").alias("id"))), scratch, "stars")
    first = scratch.store(verified(stars, scratch.store(texts, "texts-stars"), size, percent), "edges")
    scratch.drop("texts-stars", "ids-stars", "stars")
    groups = scratch.store(components(first, scratch, "groups"), "groups")
    # 5. matrix: group unions of probe tokens against queries of other groups
    rarest = F.row_number().over(W.partitionBy("node").orderBy("k", "token")) <= F.count("*").over(W.partitionBy("node")) - c("need") + 1
    member = index.select("token", "node", "n", rarest.alias("asks")).join(groups, "node", "left").select("token", "node", "n", "asks", F.coalesce("label", "node").alias("g"))
    member = scratch.store(member, "members")
    scratch.drop("index")
    matrix = member.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    span = member.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = (c("h") < c("g")) & (c("n") * 100 >= c("low") * percent) & (c("high") * 100 >= c("n") * percent)
    met = member.where("asks").join(matrix.select("token", c("g").alias("h"), "low", "high"), "token").where(near).select(c("node").alias("q"), "h").distinct()
    asked = met.join(member.select(c("node").alias("q"), "token", "n"), "q")
    open_ = asked.join(matrix.select("token", c("g").alias("h")), ["token", "h"]).groupBy("q", "h").agg(F.count("*").alias("c"), F.first("n").alias("n")).join(span.select(c("g").alias("h"), "low", "high"), "h")
    open_ = scratch.store(open_.where(qualifies(c("c"), c("n"), c("low"), c("high"), percent)).select("q", "h"), "open")
    # open groups are read in blocks of members; members that share enough probe tokens with the query are compared
    held = scratch.store(member.groupBy("node", "g").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")), "held")
    scratch.drop("members")
    sizes = held.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)).alias("blocks")).join(open_.select(c("h").alias("g")).distinct(), "g", "left_semi")
    # a large group's members meet its size in SALTS tasks, then each other in blocks
    salted = held.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    blocks = salted.join(sizes, ["g", "salt"]).groupBy(c("g").alias("h"), F.pmod(F.xxhash64("node"), c("blocks")).alias("block")).agg(F.collect_list(F.struct("node", "n", "tokens")).alias("members"))
    asked = open_.join(held.select(c("node").alias("q"), "n", "tokens"), "q").join(blocks, "h")
    near = lambda m: compatible(c("n"), m["n"]) & (F.size(F.array_intersect(c("tokens"), m["tokens"])) >= least_shared(c("n"), m["n"], percent))
    pairs = scratch.store(asked.select(c("q").alias("a"), F.explode(F.transform(F.filter("members", near), lambda m: m["node"])).alias("b")), "pairs")
    scratch.drop("held", "open")
    texts = texts_of(docs, key, text, pairs.select(c("a").alias("id")).unionByName(pairs.select(c("b").alias("id"))), scratch, "pairs")
    second = scratch.store(verified(pairs, scratch.store(texts, "texts-pairs"), size, percent), "links")
    scratch.drop("texts-pairs", "ids-pairs", "pairs")
    # 6. classes: the groups and the links between them
    return components(groups.where("node <> label").select(c("node").alias("a"), c("label").alias("b")).unionByName(second), scratch, "classes")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id (smallest id that links lead to)."""
    spark: SparkSession = docs.sparkSession
    ensure_package(spark)
    given = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    with Scratch(spark, "jaccard") as scratch:
        first = scratch.store(measured(given, key, text, size), "measured")
        sets = first.where("kind = 0").select("id", "n", "sig_a", "sig_b")
        frequent = first.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_AT).orderBy(F.desc("n"), "id").limit(FREQUENT_LIMIT).select("id")
        frequent = np.sort(frequent.toPandas()["id"].to_numpy(dtype=np.int64).view(np.uint64))
        by_set = ["n", "sig_a", "sig_b"]
        # stored, so that the last join has a shuffle of its own on either side and Spark splits a hot set's rows
        nodes = scratch.store(sets.where("n > 0 AND id IS NOT NULL").groupBy(*by_set).agg(F.min("id").alias("node")), "nodes")
        tokens = probes(given, key, text, size, percent, frequent).join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
        index = scratch.store(tokens.select(F.col("id").alias("node"), "n", F.explode("tokens").alias("token")), "probes")
        index = scratch.store(shared_only(index, scratch), "shared")
        scratch.drop("probes", "counts")
        index = scratch.store(can_link(index, percent), "linking")
        scratch.drop("shared")
        index = scratch.store(index.join(leaders(index), "token"), "index")
        scratch.drop("linking")
        labels = link_nodes(index, given, key, text, size, percent, scratch)
        named = sets.join(nodes, by_set, "left").join(labels, "node", "left")
        named = named.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("component_id"))
        return stored(named, "classes")
