"""Personal data: pattern base plus a linear-chain conditional random field.

``base_spans`` finds e-mail addresses, IP addresses, card numbers and phone
numbers by fixed patterns.  A linear-chain CRF over word-shape features then
adds spans that the patterns miss (spelt-out addresses, phone numbers without
a plus sign, and the like).  It is trained from the small labelled table that
``labelled_table`` makes from its templates, by gradient ascent on the exact
conditional likelihood, and decoded by Viterbi over numpy batches of sentences
of equal shape.  Added spans never touch a base span and are dropped where the
CRF's own posterior margin is small.

Only stretches around words that hold a digit, an ``@`` or a spelt-out ``at``
can hold a span, since every labelled span holds one; words
farther than ``REACH`` words from the next such word are outside.  That prunes
the decoding, not the text: whole texts are searched, whatever their length.

Spans are kind:start:end in code points, end exclusive, ordered by start, then
kind.  Null and empty texts have none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomlake.llm.common import map_batches

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_LOCAL_TAIL = re.compile(_LOCAL + r"+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HAS_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Words on either side of a word with a digit or an at sign that are decoded with it.
REACH = 3
#: Log-odds by which a span of the CRF must beat the reading without it.
LEAST_MARGIN = 2.0

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A match always begins where the run of local characters before its @ begins, so only @ signs are looked at."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end(), "email"
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """All pattern spans that pass their test, ordered by start, then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---------------------------------------------------------------- the field

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_TOKEN = re.compile(r"[^\s]+")
_ACTIVE = re.compile(r"[0-9@]\S*|[\[({<]\s*at\s*[\])}>]|\sat\s\S+\sdot\s", re.IGNORECASE)
_EDGE = ".,;:!?\"'"


def labelled_table(seed: int = 0, copies: int = 12) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences as words and tags, made from templates of contexts and data."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    name = lambda: pick("anna", "bob", "carla.m", "jo", "k.lee", "hsr", "info") + pick("", "", digits(2))
    host = lambda: pick("mail", "post", "example", "firm7", "web3")
    top = lambda: pick("com", "org", "net", "de", "fr")
    filler = ["the", "and", "of", "lorem", "le", "der", "para", "with", "ipsum", "then", "est", "und", "los", "this", "sent"]

    def card() -> str:
        body = [int(d) for d in "4" + digits(14)]
        check = next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))
        return "".join(map(str, [*body, check]))

    def row(kind: str, words: list[str]) -> tuple[list[str], list[str]]:
        before = [pick(*filler) for _ in range(int(rng.integers(1, 5)))]
        after = [pick(*filler) for _ in range(int(rng.integers(1, 5)))]
        lead = {"email": ["write", "to"], "phone": [pick("call", "phone", "tel", "mobile")], "card": ["card", pick("number", "no")], "ip": ["host"], "O": []}[kind] if rng.random() < 0.5 else []
        marks = ["O"] * len(words) if kind == "O" else [f"B-{kind}"] + [f"I-{kind}"] * (len(words) - 1)
        end = pick("", "", ".", ",")
        words = [*words[:-1], words[-1] + end]
        return before + lead + words + after, ["O"] * (len(before) + len(lead)) + marks + ["O"] * len(after)

    out = []
    for _ in range(copies):
        c, n = card(), digits(10)
        out += [
            row("email", [f"{name()}@{host()}.{top()}"]),
            row("email", [name(), pick("(at)", "[at]", "{at}"), host(), pick("(dot)", "[dot]", "{dot}"), top()]),
            row("email", [f"{name()}{pick('(at)', '[at]')}{host()}{pick('.', '(dot)', '[dot]')}{top()}"]),
            row("email", [name(), "@", f"{host()}.{top()}"]),
            row("phone", [f"({n[:3]})", f"{n[3:6]}-{n[6:]}"]),
            row("phone", [f"{n[:3]}-{n[3:6]}-{n[6:]}"]),
            row("phone", [f"{n[:3]}.{n[3:6]}.{n[6:]}"]),
            row("phone", ["+1", f"({n[:3]})", f"{n[3:6]}-{n[6:]}"]),
            row("phone", ["00" + pick("49", "33", "34"), n[:3], n[3:6], n[6:]]),
            row("card", [c]),
            row("card", [c[:4], c[4:8], c[8:12], c[12:]]),
            row("card", ["-".join((c[:4], c[4:8], c[8:12], c[12:]))]),
            row("ip", [".".join(str(int(x)) for x in rng.integers(1, 255, 4))]),
            row("O", [digits(int(rng.integers(1, 9)))]),
            row("O", ["Version", f"{digits(1)}.{digits(1)}."]),
            row("O", ["BY-NC", f"{digits(1)}.{digits(1)}"]),
            row("O", [f"{digits(4)}-{digits(2)}-{digits(2)}"]),
            row("O", [f"{digits(2)}.{digits(2)}.{digits(4)}"]),
            row("O", [pick("AKIA", "KEY", "SK") + "ABC" + digits(2) + "XYZ" + digits(1) + "QW" + digits(2)]),
            row("O", [f"{pick('password', 'token', 'secret')}={digits(1)}db{digits(1)}aa{digits(1)}fcc{digits(4)}"]),
            row("O", [f"\"{digits(4)}a{digits(2)}b{digits(3)}c{digits(2)}d{digits(5)}\""]),
            row("O", ["page", digits(3), "of", digits(3)]),
            row("O", [f"{digits(3)},{digits(3)},{digits(3)}"]),
            row("O", [f"{digits(2)}%", "at", digits(2), "degrees"]),
            row("O", [digits(12), digits(12)]),
            row("O", [f"@{pick('user', 'team')}{digits(2)}"]),
            row("O", [pick(*filler) for _ in range(4)]),
        ]
    return out


def shape(word: str) -> list[str]:
    """Word-shape features: the collapsed shape, digit counts and telling marks."""
    core = word.strip(_EDGE) or word
    s = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", core))
    runs = re.sub(r"9+", lambda m: f"9{min(len(m.group()), 17)}", s)
    n = sum(c.isdigit() for c in core)
    out = [f"s={runs[:40]}", f"n={min(n, 20)}", f"c={re.sub('9+', '9', s)[:24]}"]
    low = core.lower()
    out.append(f"w={low}" if n == 0 and len(low) <= 8 and low in _CUES else "w=-")
    out.append("tail=" + ("1" if word[-1:] in ".,;:!?" else "0"))
    out.append("valid=" + ("luhn" if 14 <= n <= 19 and re.fullmatch(r"[0-9 -]+", core) and luhn(re.sub(r"\D", "", core)) else "-"))
    if "@" in core:
        out.append("at=1")
    return out


_CUES = frozenset("at dot call phone tel mobile card number no host write to (at) [at] {at} (dot) [dot] {dot} page version com org net de fr".split())


@lru_cache(maxsize=20_000)
def _features(word: str) -> tuple[str, ...]:
    return tuple(shape(word))


def features(words: list[str]) -> list[list[str]]:
    own = [_features(w) if len(w) <= 64 else tuple(shape(w)) for w in words]
    out = []
    for i in range(len(words)):
        f = list(own[i])
        for d, name in ((-1, "p"), (1, "q")):
            near = own[i + d] if 0 <= i + d < len(words) else ("s=#", "n=#", "c=#", "w=#")
            f += [f"{name}{x}" for x in near[1:4]]
        out.append(f)
    return out


class CRF:
    """A linear-chain CRF with one weight for each (feature, tag) and each pair of tags."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(TAGS)))
        self.step = np.zeros((len(TAGS), len(TAGS)))
        self.first = np.zeros(len(TAGS))
        # a tag inside a span follows only its own kind
        self.allowed = np.zeros_like(self.step)
        for j, b in enumerate(TAGS):
            if b.startswith("I-"):
                for i, a in enumerate(TAGS):
                    if a[2:] != b[2:]:
                        self.allowed[i, j] = -1e4
        self.start = np.array([-1e4 if t.startswith("I-") else 0.0 for t in TAGS])

    def rows(self, words: list[str]) -> list[list[int]]:
        get = self.index.get
        return [[k for x in f if (k := get(x)) is not None] for f in features(words)]

    def emissions(self, sentences: list[list[list[int]]]) -> np.ndarray:
        """Scores for a batch of sentences of one length: sentence x word x tag."""
        n, length = len(sentences), len(sentences[0])
        flat = [k for s in sentences for w in s for k in w]
        at = np.repeat(np.arange(n * length), [len(w) for s in sentences for w in s])
        out = np.zeros((n * length, len(TAGS)))
        np.add.at(out, at, self.emit[flat])
        return out.reshape(n, length, len(TAGS))

    def fit(self, table: list[tuple[list[str], list[str]]], passes: int = 60, l2: float = 0.02) -> CRF:
        for words, _ in table:
            for f in features(words):
                for x in f:
                    self.index.setdefault(x, len(self.index))
        self.emit = np.zeros((len(self.index), len(TAGS)))
        data = [(self.rows(w), [TAGS.index(t) for t in tags]) for w, tags in table]
        params = [self.emit, self.step, self.first]
        memory = [np.full_like(p, 1e-6) for p in params]
        by_length: dict[int, list] = {}
        for rows, tags in data:
            by_length.setdefault(len(tags), []).append((rows, tags))
        for _ in range(passes):
            grads = [-l2 * p for p in params]
            for length, group in by_length.items():
                e = self.emissions([g[0] for g in group])
                tags = np.array([g[1] for g in group])
                node, edge = self.marginals(e)
                gap = -node
                gap[np.arange(len(group))[:, None], np.arange(length)[None], tags] += 1
                flat = [k for rows, _ in group for w in rows for k in w]
                at = np.repeat(np.arange(len(group) * length), [len(w) for rows, _ in group for w in rows])
                np.add.at(grads[0], flat, gap.reshape(-1, len(TAGS))[at])
                grads[1] -= edge
                if length > 1:
                    np.add.at(grads[1], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
                grads[2] += gap[:, 0].sum(axis=0)
            for p, m, g in zip(params, memory, grads):
                m += g * g
                p += 0.3 * g / np.sqrt(m)
        return self

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag probabilities of each word and summed probabilities of tag pairs (forward-backward)."""
        n, length, k = e.shape
        step = self.step + self.allowed
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = self.first + self.start + e[:, 0]
        lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + np.squeeze(m, axis)
        for t in range(1, length):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + step[None], 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = lse(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        edge = np.zeros((k, k))
        for t in range(length - 1):
            edge += np.exp(alpha[:, t, :, None] + step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
        return node, edge

    def viterbi(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of a batch of sentences of one length, and the probability of each chosen tag."""
        n, length, _ = e.shape
        step = self.step + self.allowed
        score = self.first + self.start + e[:, 0]
        back = np.zeros((length, n, len(TAGS)), dtype=np.int64)
        for t in range(1, length):
            options = score[:, :, None] + step[None]
            back[t] = options.argmax(axis=1)
            score = options.max(axis=1) + e[:, t]
        tags = np.zeros((n, length), dtype=np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags, self.marginals(e)[0]


@lru_cache(maxsize=1)
def trained(seed: int = 0) -> CRF:
    """The field fitted on the labelled table; the same in every process."""
    return CRF().fit(labelled_table(seed))


def _words_between(text: str, at: int, end: int) -> int:
    """Words from ``at`` that begin before ``end``, counted to REACH + 1."""
    n = 0
    while n <= REACH and (m := _TOKEN.search(text, at)) and m.start() < end:
        n, at = n + 1, m.end()
    return n


def stretches(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of words (with offsets) that lie within REACH words of a word that can start a span; runs that meet are one."""
    spots = []
    for m in _ACTIVE.finditer(text):
        begin, before = m.start(), spots[-1][1] if spots else 0
        while begin > before and not text[begin - 1].isspace():
            begin -= 1
        spots.append((begin, m.end()))
    if not spots:
        return []
    out: list[list[tuple[str, int, int]]] = []
    done = 0
    k = 0
    while k < len(spots):
        begin, end = spots[k]
        # widen by REACH words to the left; the stretch before ends farther away
        left = begin
        for _ in range(REACH):
            j = left
            while j > done and text[j - 1].isspace():
                j -= 1
            while j > done and not text[j - 1].isspace():
                j -= 1
            left = j
        own: list[tuple[str, int, int]] = []
        spare = REACH
        at = left
        while True:
            m = _TOKEN.search(text, at)
            if m is None:
                break
            while k < len(spots) and spots[k][1] <= m.start():
                k += 1
            if k < len(spots) and spots[k][0] < m.end():
                spare = REACH
                end = max(end, spots[k][1])
            elif m.start() >= end:
                spare -= 1
            own.append((m.group(), m.start(), m.end()))
            at = m.end()
            if spare <= 0 and not (k < len(spots) and spots[k][0] < at):
                gap = _words_between(text, at, spots[k][0]) if k < len(spots) else REACH + 1
                if gap > REACH:
                    break
                spare = gap + 1  # the next spot reaches back to here: one stretch
        done = at
        out.append(own)
        while k < len(spots) and spots[k][0] < done:
            k += 1
    return [s for s in out if s]


def added_spans(texts: list[str], base: list[list[Span]], crf: CRF) -> list[list[Span]]:
    """Spans of the field for each text of a batch that touch none of its base spans."""
    found: list[list[Span]] = [[] for _ in texts]
    starts = [[a for a, _, _ in sorted(b)] for b in base]
    reach = [list(accumulate((b for _, b, _ in sorted(own)), max)) for own in base]  # farthest end of the spans up to each
    by_length: dict[int, list[tuple[int, list[tuple[str, int, int]]]]] = {}
    for i, text in enumerate(texts):
        for s in stretches(text):
            by_length.setdefault(len(s), []).append((i, s))
    for length, group in by_length.items():
        step = max(1, 200_000 // length)
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            tags, node = crf.viterbi(crf.emissions([crf.rows([w for w, _, _ in s]) for _, s in part]))
            for row in np.flatnonzero((tags > 0).any(axis=1)):
                i, words = part[row]
                t = 0
                while t < length:
                    tag = TAGS[tags[row, t]]
                    if tag == "O":
                        t += 1
                        continue
                    u = t + 1
                    while u < length and TAGS[tags[row, u]] == f"I-{tag[2:]}":
                        u += 1
                    outside = float(node[row, t, 0])
                    if np.log(max(1 - outside, 1e-12) / max(outside, 1e-12)) >= LEAST_MARGIN:
                        begin, end = words[t][1], words[u - 1][2]
                        while begin < end - 1 and texts[i][begin] in _EDGE:
                            begin += 1
                        while end - 1 > begin and texts[i][end - 1] in _EDGE:
                            end -= 1
                        before = bisect_left(starts[i], end)
                        if not before or reach[i][before - 1] <= begin:
                            found[i].append((begin, end, tag[2:]))
                    t = u
    return found


def find(texts: list[str], crf: CRF | None = None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and all spans of each text."""
    crf = crf or trained()
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, crf)
    return base, [sorted(b + m, key=_order) for b, m in zip(base, more)]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union by the first one's kind."""
    out, at, k = [], 0, 0
    spans = sorted(spans, key=_order)
    while k < len(spans):
        a, b, kind = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < b:
            k += 1
            b = max(b, spans[k][1])
        out += [text[at:a], f"[{kind}]"]
        at = b
        k += 1
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text", redacted: str | None = None) -> DataFrame:
    """All columns of ``docs`` with counts of base spans by kind, base_sha256 and spans; same-named columns are replaced.

    ``redacted`` names a column to fill with the text without its spans (null stays null).
    """
    new = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redacted:
        new.append(T.StructField(redacted, T.StringType()))
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + new)
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # one model of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            base, spans, clean = [], [], []
            for lo in range(0, len(column), 512):
                given = column.slice(lo, 512).to_pylist()
                texts = [t or "" for t in given]
                b, s = find(texts, crf)
                base += b
                spans += s
                if redacted:
                    clean += [None if g is None else redact(t, x) for g, t, x in zip(given, texts, s)]
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays += [pa.array([sum(x[2] == k for x in b) for b in base], pa.int64()) for k in KINDS]
            arrays += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(s) for s in spans], pa.string())]
            if redacted:
                arrays.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(frame, run, schema)
