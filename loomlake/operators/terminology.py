"""Terminology: candidate terms from texts, merging with an earlier report, review and validation, matching and annotation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomlake.functions.text import collapse, glob_to_regex
from loomlake.runtime import ensure_package, pieces

c = F.col
#: Classes and policies of terms, source types and their modes, ambiguous short forms, and the count from which a candidate is a new term.
CLASSES = ["business", "system", "organisation", "process", "technology", "person"]
ANNOTATE, BLOCK = ["first_occurrence", "never"], ["include", "exclude"]
SOURCES = ["confluence", "jira", "mail", "teams", "scrape"]
MODES = ["off", "annotate_and_block", "block_only"]
SHORTFORMS = ["PM", "CI", "PO"]
NEW_TERM_AT = 3
#: The text of the terminology block, the pattern of candidates, and the characters around one that its report shows.
BLOCK_HEADING, RELATED, ALIASES = "## Terminologie", "Verwandte Begriffe", "Aliase"
CANDIDATE = r"\b[A-ZÄÖÜ][A-ZÄÖÜ0-9]{1,}(?:-[A-Za-zÄÖÜäöü0-9]+)*\b"
CONTEXT = 40
#: Characters of forms in one automaton of ``occurrences``, and at most in that of ``apply``.
PART_CHARS, MOST_CHARS = 1_000_000, 4_000_000
#: Characters of a form that the automaton holds at most.
LONG_FORM = 500
#: Columns of the candidate report, with what an older report without them stands for.
REPORT = {
    "source_type": "", "term": "", "count": "0", "first_seen_file": "", "last_seen_file": "", "example_context": "",
    "already_known": "false", "suggested_action": "needs_review", "selected_term_id": "", "reviewer_status": "open", "reviewer_note": "",
}


def normalised(term: Column) -> Column:
    return F.lower(collapse(term))


def spans(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, key, pos, begin, end, term, context): each match of a pattern with its place and CONTEXT characters on either side, white space collapsed.

    Matches are made in the scan of the texts and nothing else of these goes on; null sources and keys are kept.
    """
    ensure_package(docs.sparkSession)
    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in (source, key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            row, found = [], []
            for i, t in enumerate(piece.column(2).to_pylist()):
                for n, m in enumerate(re.finditer(pattern, t or "")):
                    row.append(i)
                    found.append((n, m.start(), m.end(), m.group(), " ".join(t[max(0, m.start() - CONTEXT) : m.end() + CONTEXT].split())))
            own = list(zip(*found)) or [()] * 5
            at = pa.array(row, pa.int64())
            columns = [piece.column(0).take(at), piece.column(1).take(at), *(pa.array(v, pa.int32()) for v in own[:3]), *(pa.array(v, pa.string()) for v in own[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=[source, key, "pos", "begin", "end", "term", "context"])

    return docs.select(source, key, text).mapInArrow(run, f"{', '.join(kinds)}, pos int, begin int, end int, term string, context string")


def candidates(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", source: str = "source", exclude: list[str] | None = None) -> DataFrame:
    """Terms that a pattern finds, by source and normalised term: count, first form and its context, first and last document."""
    rows = spans(docs, pattern, key, text, source).withColumn("norm", normalised(c("term"))).where("norm <> ''")
    for glob in exclude or []:
        rows = rows.where(~c("norm").rlike(glob_to_regex(glob.lower())))
    first = F.min(F.struct(key, "pos", "term", "context"))
    rows = rows.groupBy(source, "norm").agg(F.count("*").alias("n"), first.alias("_first"), F.min(key).alias("first_seen"), F.max(key).alias("last_seen"))
    return rows.select(source, "norm", "n", c("_first.term").alias("term"), "first_seen", "last_seen", c("_first.context").alias("example_context"))


def merge_report(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """Earlier candidates with the new counts added; first form and first document are the earlier ones."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, c(f"o.{source}").eqNullSafe(c(f"n.{source}")) & (c("o.norm") == c("n.norm")), "full")
    pick = lambda x: F.coalesce(c(f"o.{x}"), c(f"n.{x}")).alias(x)
    shown = [pick("example_context")] if "example_context" in old.columns and "example_context" in new.columns else []
    return both.select(pick(source), pick("norm"), (F.coalesce("o.n", F.lit(0)) + F.coalesce("n.n", F.lit(0))).alias("n"), pick("term"), pick("first_seen"), F.coalesce("n.last_seen", "o.last_seen").alias("last_seen"), *shown)


def review(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What to do with each candidate: known (norm, term_id) terms get it as an alias."""
    k = known.groupBy("norm").agg(F.max("term_id").alias("term_id"))
    rows = rows.join(k, "norm", "left")
    action = F.when(c("term_id").isNotNull(), "add_alias").when(c("n") >= NEW_TERM_AT, "new_term").otherwise("needs_review")
    return rows.withColumns({"known": c("term_id").isNotNull(), "action": action, "state": F.when(c("term_id").isNotNull(), "done").otherwise("open")})


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A candidate report in CSV; columns that an older one lacks get their defaults."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    columns = {n: F.coalesce(F.when(F.trim(n) != "", c(n)), F.lit(d)) if n in rows.columns else F.lit(d) for n, d in REPORT.items()}
    return rows.select(*[v.alias(n) for n, v in columns.items()]).withColumn("count", F.coalesce(F.expr("try_cast(count AS BIGINT)"), F.lit(0)))


def write_report(rows: DataFrame, path: str) -> bool:
    """Writes a candidate report in its order: by source, normalised term, term. Without rows an earlier report stays."""
    if rows.isEmpty():
        return False
    rows.select(*REPORT).orderBy("source_type", normalised(c("term")), "term").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def source_modes(rows: DataFrame, modes: DataFrame, source: str = "source") -> DataFrame:
    """Rows with mode and candidates: modes (source, mode, candidates_enabled) by source; an unknown source is off."""
    m = modes.select(c("source").alias("_source"), c("mode").alias("_mode"), "candidates_enabled")
    mode = F.coalesce(c("_mode"), F.lit("off"))
    rows = rows.join(m, rows[source] == m["_source"], "left")
    return rows.withColumns({"mode": mode, "candidates": (mode != "off") & F.coalesce("candidates_enabled", mode != "off")}).drop("_source", "_mode", "candidates_enabled")


def in_force(terms: DataFrame) -> DataFrame:
    """Of each term id the last entry (by ord), as later entries replace earlier ones; blank ids are no terms."""
    own = terms.where(F.trim(F.coalesce("term_id", F.lit(""))) != "")
    return own.withColumn("_rn", F.row_number().over(W.partitionBy("term_id").orderBy(F.desc("ord")))).where("_rn = 1").drop("_rn")


def statistics(terms: DataFrame) -> DataFrame:
    """One row: terms, aliases, relations."""
    return in_force(terms).agg(F.count("*").alias("terms"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases"), F.coalesce(F.sum(F.size("related")), F.lit(0)).alias("relations"))


def validate(terms: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(severity, code, term_id, detail) for each rule that a term breaks.

    terms: ord, term_id, canonical, label, description, term_class, aliases, annotate, block, applies_to, related.
    Of entries that use one canonical form, alias or id the first in order is right and each later one is reported.
    """
    own = in_force(terms)

    def issue(rows: DataFrame, severity: str, code: str, detail: Column) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), c("term_id"), detail.cast("string").alias("detail"))

    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    fields = F.array(*[F.when(blank(x), F.lit(x)) for x in ("canonical", "label", "description", "term_class")])
    missing = own.select("term_id", F.explode(F.array_compact(fields)).alias("field"))
    names = own.withColumn("_n", F.row_number().over(W.partitionBy(F.lower(F.coalesce("canonical", F.lit("")))).orderBy("ord")))
    alias = own.select("term_id", "ord", F.posexplode("aliases").alias("pos", "a"))
    alias = alias.withColumn("_before", F.lag("term_id").over(W.partitionBy(F.lower("a")).orderBy("ord", "pos")))
    related = own.select("term_id", F.explode("related").alias("r"))
    ids = terms.withColumn("term_id", F.trim(F.coalesce("term_id", F.lit("")))).where("term_id <> ''").withColumn("_n", F.row_number().over(W.partitionBy("term_id").orderBy("ord")))
    out = [
        issue(missing, "error", "required_field", c("field")),
        issue(names.where("_n > 1"), "error", "duplicate_canonical", c("canonical")),
        issue(own.where(~F.coalesce(c("term_class").isin(CLASSES), F.lit(False))), "error", "invalid_term_class", c("term_class")),
        issue(own.where(~F.coalesce(c("annotate").isin(ANNOTATE), F.lit(False))), "error", "invalid_annotate_policy", c("annotate")),
        issue(own.where(~F.coalesce(c("block").isin(BLOCK), F.lit(False))), "error", "invalid_block_policy", c("block")),
        issue(own.select("term_id", F.explode("applies_to").alias("s")).where(~c("s").isin(sources or SOURCES)), "error", "unknown_source_type", c("s")),
        issue(alias.where("_before <> term_id"), "error", "duplicate_alias", c("a")),
        issue(related.join(own.select(c("term_id").alias("r")), "r", "left_anti"), "error", "invalid_relation_target", c("r")),
        issue(ids.where("_n > 1"), "error", "duplicate_id", c("term_id")),
        issue(own.where("term_class = 'person' AND annotate <> 'never'"), "warning", "person_annotation", c("annotate")),
        issue(own.where(F.upper("canonical").isin(SHORTFORMS)), "warning", "ambiguous_shortform", c("canonical")),
        issue(alias.where(F.upper("a").isin(SHORTFORMS)), "warning", "ambiguous_shortform", c("a")),
    ]
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


@dataclass(frozen=True)
class Term:
    """A term; ``related`` holds the ids of its ``related_to`` relations."""

    term_id: str
    canonical: str
    aliases: tuple[str, ...] = ()
    label: str = ""
    priority: int = 100
    annotate: str = "first_occurrence"
    block: str = "include"
    term_class: str = "business"
    case_sensitive: bool = False
    applies_to: tuple[str, ...] = ()
    related: tuple[str, ...] = field(default=())


class _Folded(dict):
    """Each code point's stand-in under which forms and texts are compared without case; one code point for one."""

    #: Code points that count as equal without case though their lower forms differ.
    SAME = {"İ": "i", "ı": "i", "ΐ": "ΐ", "ΰ": "ΰ", "ﬅ": "ﬆ"}

    def __missing__(self, point: int) -> str:
        x = self.SAME.get(chr(point), chr(point))
        self[point] = out = next((y for y in (x.casefold(), x.lower()) if len(y) == 1), x)
        return out


_folded = _Folded()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_folded)


@lru_cache(maxsize=100_000)
def _same(form: str, said: str) -> bool:
    return re.fullmatch(re.escape(form), said, re.IGNORECASE) is not None


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


class Forms:
    """All forms of a list of terms as one automaton over case-folded text: one pass finds every form, however many there are.

    What is broadcast are the terms; each worker builds the automaton once.
    """

    def __init__(self, terms: Iterable[Term]):
        self.terms = list(terms)
        self.names = {t.term_id: t.canonical for t in self.terms}
        self.entries: list[list[tuple[int, str]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.long: list[tuple[str, int]] = []  # the automaton's depth is bounded; longer forms are looked up one by one
        known: dict[str, int] = {}
        for order, t in enumerate(self.terms):
            for form in dict.fromkeys(f for f in (t.canonical, *t.aliases) if f):
                at = known.setdefault(fold(form), len(known))
                if at == len(self.entries):
                    self.entries.append([])
                    if len(form) <= LONG_FORM:
                        self.automaton.add_word(fold(form), at)
                    else:
                        self.long.append((fold(form), at))
                self.entries[at].append((order, form))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __reduce__(self):
        return Forms, (self.terms,)

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, entry) of each form in a folded text; those of one entry in order."""
        if len(self.automaton):
            for last, at in self.automaton.iter(text):
                yield last + 1, at
        for form, at in self.long:
            begin = text.find(form)
            while begin >= 0:
                yield begin + len(form), at
                begin = text.find(form, begin + 1)

    def match(self, text: str, source: str | None = None) -> list[tuple[int, int, Term, str]]:
        """Whole-word matches of canonical forms and aliases, each span once for each term; terms by their first match, a term's matches by position."""
        if not self.entries:
            return []
        spans: dict[int, set[tuple[int, int]]] = {}
        ends: dict[tuple[int, str], int] = {}
        n = len(text)
        for end, at in self.places(fold(text)):
            begin = end - len(self.entries[at][0][1])
            if begin and _word(text[begin - 1]) or end < n and _word(text[end]):
                continue
            said = text[begin:end]
            for order, form in self.entries[at]:
                t = self.terms[order]
                if t.applies_to and source not in t.applies_to or said != form and (t.case_sensitive or not _same(form, said)):
                    continue
                if ends.get((order, form), 0) <= begin:  # matches of one form do not overlap
                    ends[order, form] = end
                    spans.setdefault(order, set()).add((begin, end))
        own = {order: sorted(found) for order, found in spans.items()}
        return [(a, b, self.terms[order], text[a:b]) for order in sorted(own, key=lambda o: (own[o][0][0], o)) for a, b in own[order]]


def match(text: str, terms: list[Term], source: str | None = None) -> list[tuple[int, int, Term, str]]:
    """The matches of one text (see ``Forms``)."""
    return Forms(terms).match(text, source)


def parts_of(terms: list[Term], most: int) -> list[Forms]:
    """The terms as automata of at most ``most`` characters of forms each (one longer form is one by itself).

    Forms go to parts in their folded order, so those of the same first letters stay together; a term may be in several parts.
    """
    forms = sorted((fold(f), order, f) for order, t in enumerate(terms) for f in {t.canonical, *t.aliases} if f)
    out: list[dict[int, list[str]]] = [{}]
    size = 0
    for _, order, form in forms:
        if size and size + len(form) > most:
            out.append({})
            size = 0
        out[-1].setdefault(order, []).append(form)
        size += len(form)
    return [Forms(replace(terms[order], canonical=own[0], aliases=tuple(own[1:])) for order, own in sorted(part.items())) for part in out]


def occurrences(docs: DataFrame, terms: list[Term], key: str = "doc_id", text: str = "text", source: str | None = None, most: int = PART_CHARS) -> DataFrame:
    """(key, begin, end, term_id, said): all matches of all documents, each span once for each term.

    One scan of the texts for each part of the terms; there is no bound on their number.
    """
    spark = docs.sparkSession
    ensure_package(spark)
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(c(key), c(text).alias("__text"), (c(source) if source else F.lit(None)).cast("string").alias("__source"))

    def found(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(k, a, b, t.term_id, said) for k, x, src in zip(batch[key], batch["__text"], batch["__source"]) for a, b, t, said in shared.value.match(x or "", src)]
                yield pd.DataFrame(rows, columns=[key, "begin", "end", "term_id", "said"]).astype({"begin": "int32", "end": "int32"})

        return run

    out = None
    many = parts_of(terms, most)
    for part in many:
        rows = given.mapInPandas(found(spark.sparkContext.broadcast(part)), f"`{key}` {kind}, begin int, end int, term_id string, said string")
        out = rows if out is None else out.unionByName(rows)
    return out if len(many) == 1 else out.distinct()  # forms of one term that differ in case only may lie in two parts


def _first(hits: list[tuple[int, int, Term, str]]) -> list[tuple[int, int, Term, str]]:
    """The first match of each term."""
    out: dict[str, tuple] = {}
    for h in hits:
        if h[2].term_id not in out or h[:2] < out[h[2].term_id][:2]:
            out[h[2].term_id] = h
    return list(out.values())


def annotate(text: str, hits: list[tuple[int, int, Term, str]]) -> tuple[str, int]:
    """Puts each term's label in brackets behind its first match, from the last to the first; persons are never annotated."""
    first = [h for h in _first(hits) if h[2].annotate == "first_occurrence" and h[2].term_class != "person"]
    for a, b, t, said in sorted(first, key=lambda h: h[0], reverse=True):
        text = f"{text[:a]}{said} ({t.label}){text[b:]}"
    return text, len(first)


def block(hits: list[tuple[int, int, Term, str]], terms: list[Term] | dict[str, str], least: int = 2, aliases: bool = False) -> str:
    """The terminology block of the terms that occur and are not excluded, by first match, priority and name; empty for fewer than ``least``."""
    own = [h for h in _first(hits) if h[2].block != "exclude"]
    if len(own) < least:
        return ""
    names, lines = terms if isinstance(terms, dict) else {t.term_id: t.canonical for t in terms}, ["", BLOCK_HEADING]
    for _, _, t, _ in sorted(own, key=lambda h: (h[0], h[2].priority, h[2].canonical.lower())):
        lines.append(f"- {t.canonical}: {t.label}")
        if rel := [names[r] for r in t.related if r in names]:
            lines.append(f"  - {RELATED}: {', '.join(rel)}")
        if aliases and t.aliases:
            lines.append(f"  - {ALIASES}: {', '.join(t.aliases)}")
    return "\n".join(lines) + "\n"


def apply(docs: DataFrame, terms: list[Term], modes: DataFrame, text: str = "text", source: str = "source", least: int = 2, aliases: bool = False) -> DataFrame:
    """Documents with n_matches, first_match (-1: none), annotations, block_added and the processed text in place of the text.

    A source whose mode is off, or that is not in ``modes``, is left as it is.  The terms are broadcast as one automaton;
    more of them than MOST_CHARS allows are refused (``occurrences`` takes any number).
    """
    ensure_package(docs.sparkSession)
    if sum(len(f) for t in terms for f in (t.canonical, *t.aliases)) > MOST_CHARS:
        raise ValueError(f"the terms' forms have more than {MOST_CHARS} characters")
    shared = docs.sparkSession.sparkContext.broadcast(Forms(terms))

    def processed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for piece in pieces(pa.RecordBatch.from_arrays(list(x), names=["text", "source", "mode"]) for x in batches):
            out = []
            for given, src, mode in zip(*(x.to_pylist() for x in piece.columns)):
                said = given or ""
                hits = [] if mode == "off" else shared.value.match(said, src)
                added = block(hits, shared.value.names, least, aliases) if mode in MODES[1:] else ""
                done, n = annotate(said, hits) if mode == MODES[1] else (said, 0)
                done = f"{done.rstrip()}\n{added}" if added else done
                out.append((len(hits), min((h[0] for h in hits), default=-1), n, bool(added), given if given is None else done))
            columns = [pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))]
            yield pa.StructArray.from_arrays(columns, names=["n_matches", "first_match", "annotations", "block_added", "text"])

    rows = source_modes(docs, modes, source)
    done = F.arrow_udf(processed, "n_matches int, first_match int, annotations int, block_added boolean, text string")(c(text), F.coalesce(source, F.lit("")), c("mode"))
    return rows.withColumn("_done", done).select(*[x for x in docs.columns if x != text], "_done.*").withColumnRenamed("text", text)
