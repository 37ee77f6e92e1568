"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades 0 < 1 < ... < K-1 share one weight vector; ``P(grade > k) = sigmoid(score - threshold[k])`` with ordered
thresholds.  The expected severity is the sum of these probabilities.  Tables that know only toxic or not get their
grades from the text: a toxic document is of grade 2 if it holds more of the words that are typical of toxic documents
(by the sum of the values that the features have) than the median toxic document, else of grade 1.

The model is fitted on the driver from a sample of at most ``TRAIN_ROWS`` labelled documents; scoring runs on all rows.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, uniform
from .hashed import Design, Scorer, fit, sigmoid

#: Labelled documents in the sample, and different words of each that the fit looks at (the least by CRC-32 if it has more).
TRAIN_ROWS, TRAIN_WORDS, SEED = 8_000, 1_000, 1
REJECT = 0.5
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> Counter:
    """Words of a whole text, lower-cased, with their numbers."""
    return Counter(_WORD.findall((text or "").lower()))


def _sampled_words(text: str | None) -> Counter:
    """At most ``TRAIN_WORDS`` of a whole text's words, with their numbers."""
    found = words_of(text)
    if len(found) <= TRAIN_WORDS:
        return found
    return Counter({w: found[w] for w in heapq.nsmallest(TRAIN_WORDS, found, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))})


def _value(n: int) -> float:
    return 1.0 + math.log(n) if n > 1 else 1.0


@dataclass
class OrdinalModel:
    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, scores) -> np.ndarray:
        """(expected severity, probability of a grade above 0) in two columns."""
        above = sigmoid(np.asarray(scores, float)[:, None] - self.thresholds[None, :])
        return np.stack([above.sum(1), above[:, 0]], 1)


def _gradients(grades: np.ndarray, thresholds: int):
    """Loss gradients of the cumulative-link model; extra = (first threshold, logarithms of the gaps)."""

    def loss(score: np.ndarray, extra: np.ndarray):
        cuts = np.concatenate([[extra[0]], extra[0] + np.cumsum(np.exp(extra[1:]))])
        upper = np.concatenate([[-np.inf], cuts, [np.inf]])
        a, b = sigmoid(score - upper[grades]), sigmoid(score - upper[grades + 1])
        p = np.maximum(a - b, 1e-12)
        at = np.zeros(thresholds)
        np.add.at(at, grades[grades > 0] - 1, (a * (1 - a) / p)[grades > 0])
        inner = grades < thresholds
        np.add.at(at, grades[inner], -(b * (1 - b) / p)[inner])
        by_extra = np.concatenate([[at.sum()], np.exp(extra[1:]) * np.cumsum(at[::-1])[::-1][1:]])
        return -(1 - a - b), by_extra

    return loss


def fit_ordinal(vocabulary, doc, word, value, grades: np.ndarray) -> OrdinalModel:
    """Ordinal model of documents given as triples (document, place in the vocabulary, value)."""
    k = int(grades.max(initial=0))
    n = len(grades)
    if k == 0 or not (grades == 0).any():
        share = min(max(k and 1 - 1e-6, 1e-6), 1 - 1e-6)
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.array([math.log((1 - share) / share)] * max(1, k)))
    design = Design(vocabulary, doc, word, value, n)
    design.select((grades > 0).astype(float))
    above = [min(max((grades > i).mean(), 1e-4), 1 - 1e-4) for i in range(k)]
    cuts = np.log([(1 - p) / p for p in above])
    extra = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 0.1))])
    w, extra = fit(design, _gradients(grades, k), extra)
    used = w != 0
    cuts = np.concatenate([[extra[0]], extra[0] + np.cumsum(np.exp(extra[1:]))])
    return OrdinalModel(design.used[used], w[used], cuts)


def grades_from_text(toxic: np.ndarray, doc: np.ndarray, word: np.ndarray, value: np.ndarray, n_vocabulary: int) -> np.ndarray:
    """Grades 0, 1, 2 of documents that are toxic or not (see the module's text)."""
    grades = toxic.astype(np.int64)
    bad = toxic[doc] > 0
    in_bad = np.bincount(word[bad], minlength=n_vocabulary)
    in_good = np.bincount(word[~bad], minlength=n_vocabulary)
    rate = (in_bad + 0.1) / max(1, toxic.sum()) / ((in_good + 0.1) / max(1, (1 - toxic).sum()))
    typical = (rate > 20) & (in_bad >= 2)
    mass = np.bincount(doc, value * typical[word], len(toxic))
    if toxic.any():
        grades[(toxic > 0) & (mass > np.median(mass[toxic > 0]))] = 2
    return grades


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Model from documents (doc_id, text) and labels (doc_id, toxic); of repeated labels the severest counts.

    The sample: the ``rows`` labelled ids that come first in a seeded order, one document of each (of a repeated id the
    text of least MD5), and at most ``TRAIN_WORDS`` words of it; so what comes to the driver is bounded.  Integer labels
    above 1 are grades.  Without any toxic row, nothing is toxic.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_grade"))
    known = known.orderBy(uniform(F.col("_id"), seed=SEED), "_id").limit(rows)  # bounded, so it may be broadcast
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_id")
    picked = picked.groupBy("_id", "_grade").agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text"))

    def run(batches):
        for b in batches:
            found = [_sampled_words(t) for t in b["text"].to_pylist()]
            yield {"id": b["_id"], "grade": b["_grade"], "words": [list(f) for f in found], "counts": [list(f.values()) for f in found]}

    got = in_arrow(picked, run, "id long, grade int, words array<string>, counts array<int>").toArrow().combine_chunks()
    return _trained(got)


def _trained(got) -> OrdinalModel:
    order = np.lexsort((got["grade"].to_numpy(), got["id"].to_numpy()))
    got = got.take(order)  # tasks end in any order
    lists = got["words"].combine_chunks()
    codes = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().to_numpy() if len(lists) else np.zeros(0, np.int64)
    doc, word = np.repeat(np.arange(len(lists)), sizes), codes.indices.to_numpy()
    counts = got["counts"].combine_chunks().flatten().to_numpy().astype(float)
    grades = np.maximum(0, got["grade"].to_numpy().astype(np.int64)) if len(lists) else np.zeros(0, np.int64)
    value = 1 + np.log(np.maximum(1, counts))
    if grades.max(initial=0) == 1:
        grades = grades_from_text(grades, doc, word, value, len(codes.dictionary))
    return fit_ordinal(codes.dictionary.to_pylist(), doc, word, value, grades)


def _rater(model: OrdinalModel):
    scorer = Scorer(model.places, model.weights)

    def rate(texts: list[str | None]) -> np.ndarray:
        scores = np.zeros(len(texts))
        for i, t in enumerate(texts):
            word = scorer.word
            scores[i] = sum([s * _value(n) for w, n in words_of(t).items() if (s := word(w))])
        return model.severity(scores)

    return rate


def graded(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, rejected) for each row of ``docs`` (doc_id, text; others are ignored).

    Whole texts are read.  Null and empty texts have no features: they get what the thresholds alone say.  A row is
    rejected if a grade above 0 has at least the probability ``reject``: as all thresholds share the score, that is a
    cut of the expected severity too.  Repeated rows are graded one by one.
    """

    def run(batches):
        rate = _rater(model)
        for b in batches:
            got = rate(b["text"].to_pylist())
            yield {"doc_id": b["doc_id"], "expected_severity": got[:, 0], "p_toxic": got[:, 1], "rejected": got[:, 1] >= reject}

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, expected_severity double, p_toxic double, rejected boolean")


def accepted(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, with all columns, that :func:`graded` doesn't reject."""
    import pyarrow as pa

    def run(batches):
        rate = _rater(model)
        for b in batches:
            got = rate(b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist())
            yield b.filter(pa.array(got[:, 1] < reject, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
