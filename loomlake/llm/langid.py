"""Language identification in two levels.

Level one predicts the family of a text's language with one-against-rest
logistic models; level two separates the languages of that family with
one-versus-one linear support vector machines (squared hinge).  Features are
relative frequencies of hashed byte n-grams (1 to 4) of the text with ASCII
letters lower-cased and everything else that is no letter turned into spaces.

A text that is null, empty or without any letter gets language ``und`` and
score 0.  Ties between languages go to the one with the larger margin sum, then
to the first by name.  Where nothing can be learned every text gets ``und``.
Rows with a null text, label or id are not learned from; of several texts of one
id and label the last in order is.  Labels beyond the 120 most frequent are not
learned.  Letters are the characters of Unicode's category L.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.llm.common import TextBatch, map_batches
from loomlake.llm.hashed import Space, bounded_sample, collect_vectors, fit_linear, linear_scores, one_text, platt, sigmoid

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "zh yue",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "rw sn sw xh zu",
}
#: Labelled rows that the models are fitted on at most, or so many of each language if that is more.
SAMPLE_ROWS, LEAST_ROWS = 2400, 20
UNDETERMINED = "und"

_letters = np.full(256, 0x20, dtype=np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[65:91] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)
FEATURES = Space(word_bits=0, gram_bits=11, grams=(1, 2, 3, 4), byte_map=_letters.tobytes())
_ANY_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family_of(lang: str) -> str:
    for name, members in FAMILIES.items():
        if lang in members.split():
            return name
    return lang


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and bool(_ANY_LETTER.search(text.decode("utf-8", "replace"))))


@dataclass
class Model:
    """Weights of all linear models side by side: families first, then the pairs within each family."""

    space: Space
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    slopes: np.ndarray | None = None
    shifts: np.ndarray | None = None

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score, from the margins of all models (documents x models)."""
        n, k = len(margins), len(self.families)
        p = sigmoid(margins * self.slopes + self.shifts)
        if k > 1:
            of_family = p[:, :k] / np.maximum(p[:, :k].sum(axis=1, keepdims=True), 1e-12)
            family = of_family.argmax(axis=1)
        else:
            of_family, family = np.ones((n, 1)), np.zeros(n, dtype=np.int64)
        votes = np.full((n, len(self.languages)), -1.0)
        chance = np.zeros((n, len(self.languages)))
        belongs = np.array([self.families.index(family_of(x)) for x in self.languages])
        for i in range(len(self.languages)):
            own = family == belongs[i]
            votes[own, i] = 0.0
            chance[own, i] = 1.0
        for m, (i, j) in enumerate(self.pairs, start=k if k > 1 else 0):
            own = family == belongs[i]
            first = margins[:, m] > 0
            soft = p[:, m]
            votes[own, i] += first[own] + 1e-3 * soft[own]
            votes[own, j] += ~first[own] + 1e-3 * (1 - soft[own])
            chance[own, i] *= soft[own]
            chance[own, j] *= 1 - soft[own]
        best = votes.argmax(axis=1)
        rows = np.arange(n)
        within = chance[rows, best] / np.maximum(chance.sum(axis=1), 1e-12)
        return best, np.clip(of_family[rows, family] * within, 0.0, 1.0)


def fit(x: np.ndarray, labels: list[str], space: Space = FEATURES) -> Model | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    model = Model(space, languages, sorted({family_of(x) for x in languages}))
    lang = np.array([languages.index(v) for v in labels])
    fam = np.array([model.families.index(family_of(v)) for v in labels])
    weights, bias, slopes, shifts = [], [], [], []

    def add(rows: np.ndarray, y: np.ndarray, loss: str) -> None:
        order = np.random.default_rng(0).permutation(len(rows))
        held = order[: len(rows) // 5]
        own = order[len(rows) // 5 :]
        if len(set(y[own].tolist())) < 2 or len(set(y[held].tolist())) < 2:
            own = held = order
        w, b = fit_linear(x[rows[own]], y[own], loss)
        s, t = platt(x[rows[held]] @ w + b, y[held])
        weights.append(w), bias.append(b), slopes.append(s), shifts.append(t)

    every = np.arange(len(labels))
    if len(model.families) > 1:
        for k in range(len(model.families)):
            add(every, np.where(fam == k, 1.0, -1.0), "logistic")
    for i in range(len(languages)):
        for j in range(i + 1, len(languages)):
            if family_of(languages[i]) == family_of(languages[j]):
                rows = np.flatnonzero((lang == i) | (lang == j))
                add(rows, np.where(lang[rows] == i, 1.0, -1.0), "squared_hinge")
                model.pairs.append((i, j))
    model.weights = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((space.size, 1), np.float32)
    model.bias, model.slopes, model.shifts = (np.array(v) if v else np.zeros(1) for v in (bias, slopes, shifts))
    return model


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text", label: str = "lang", key: str = "doc_id", where: Column | None = None) -> Model | None:
    """Fits the models on at most about ``rows`` labelled documents, chosen by hash of their id, evenly by language.

    Every language of the labelled rows is learned: with more than rows / LEAST_ROWS of them, the bound is LEAST_ROWS a language.
    """
    known = docs if where is None else docs.where(where)
    known = known.where(F.col(label).isNotNull() & (F.col(label) != UNDETERMINED) & F.col(text).isNotNull())
    rows = max(rows, LEAST_ROWS * known.select(label).distinct().count())
    sample = bounded_sample(known.select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(label).alias("__label")), "__label", "__id", rows)
    return fit(*collect_vectors(one_text(sample), "__text", "__label", FEATURES, rows))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1); same-named columns are replaced.

    Only the text is read for a prediction.
    """
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in {"lang_pred", "score"}]
    schema = T.StructType(kept + new)
    frame = docs.select(*[f.name for f in kept], docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = TextBatch(batch.column(batch.num_columns - 1))
            names, scores = [], []
            for r in texts.runs():
                best, score = model.predict(linear_scores(r, model.space, model.weights, model.bias)) if model else (np.zeros(len(r), int), np.zeros(len(r)))
                for i in range(len(r)):
                    known = model is not None and has_letter(texts.text(r.first + i))
                    names.append(model.languages[best[i]] if known else UNDETERMINED)
                    scores.append(float(score[i]) if known else 0.0)
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_batches(frame, run, schema)
