"""Hashed sparse text features and linear models over them, fitted on a bounded sample and applied word by word.

A word's features are itself and its character 4-grams, hashed to ``2**BITS`` weights.  A document's score is a sum over
its words, so a worker keeps each word's sum of weights once it has met it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

BITS, GRAM = 20, 4
_MASK = (1 << BITS) - 1


def features(word: str) -> list[int]:
    """Places of a word's features; a word with a space, which no text has, is one feature."""
    crc, whole = zlib.crc32, f"<{word}>"
    out = [crc(whole.encode("utf-8", "surrogatepass")) & _MASK]
    if " " in word:
        return out
    for i in range(len(whole) - GRAM + 1):
        out.append(crc(whole[i : i + GRAM].encode("utf-8", "surrogatepass"), 1) & _MASK)
    return out


class Design:
    """A sparse document-by-feature matrix, kept as documents by words and words by features."""

    def __init__(self, vocabulary: Sequence[str], doc: np.ndarray, word: np.ndarray, value: np.ndarray, n_docs: int):
        self.n_words = len(vocabulary)
        # as many as features() gives; lists of them would take much more memory than their numbers
        sizes = np.fromiter((1 if " " in w else max(1, len(w)) for w in vocabulary), np.int64, self.n_words)
        places = np.fromiter(chain.from_iterable(map(features, vocabulary)), np.int32, int(sizes.sum()))
        self.used, self.place = np.unique(places, return_inverse=True)
        self.place = self.place.astype(np.int32)
        self.of = np.repeat(np.arange(self.n_words, dtype=np.int32), sizes)
        self.doc, self.word, self.value, self.n_docs = doc, word, value, n_docs

    def select(self, share: np.ndarray, least: float = 30.0) -> None:
        """Keep the features that tell documents with a high ``share`` (0 to 1) from the others: those whose
        occurrences in both differ from the overall ratio by a log-likelihood ratio of ``least`` or more."""
        value, self.value = self.value, np.ones(len(self.value))
        one, zero = self.transposed(share), self.transposed(1 - share)
        a, b = one.sum(), zero.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda n, e: np.where(n > 0, n * np.log(n / e), 0)
            ratio = 2 * (part(one, (one + zero) * a / (a + b)) + part(zero, (one + zero) * b / (a + b)))
        keep = ratio >= least
        # words without such a feature drop out of the matrix
        new = np.cumsum(keep) - 1
        mine = keep[self.place]
        self.used, self.place, self.of = self.used[keep], new[self.place[mine]], self.of[mine]
        has = np.zeros(self.n_words, bool)
        has[self.of] = True
        rows = has[self.word]
        self.doc, self.word, self.value = self.doc[rows], self.word[rows], value[rows]

    def times(self, w: np.ndarray) -> np.ndarray:
        words = np.bincount(self.of, w[self.place], self.n_words)
        return np.bincount(self.doc, words[self.word] * self.value, self.n_docs)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        words = np.bincount(self.word, g[self.doc] * self.value, self.n_words)
        return np.bincount(self.place, words[self.of], len(self.used))


def fit(design: Design, loss: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], extra: np.ndarray, rounds: int = 400, rate: float = 0.1, shrink: float = 3e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights over ``design.used`` and parameters ``extra`` that lower a mean loss with a squared penalty on the weights.

    ``loss(scores, extra)`` returns the gradients by score (per document) and by extra parameter, of the sum.  Full
    gradients, Adam's steps with a rate that falls to zero; nothing is random.
    """
    n, k = max(1, design.n_docs), len(design.used)
    x = np.concatenate([np.zeros(k), extra.astype(float)])
    mean, square = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        by_score, by_extra = loss(design.times(x[:k]), x[k:])
        g = np.concatenate([design.transposed(by_score), by_extra]) / n
        g[:k] += shrink * x[:k]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        step = rate * (1 - t / (rounds + 1)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        x = x - step * mean / (1 - 0.9**t)
    return x[:k], x[k:]


class Scorer:
    """Sums of weights by word, remembered up to a bound; one per task."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, remembered: int = 300_000):
        self.dense = np.zeros(1 << BITS)
        self.dense[places] = weights
        self.flat = self.dense.tolist()
        self.remembered, self.known = remembered, {}

    def word(self, word: str) -> float:
        if (got := self.known.get(word)) is None:
            flat = self.flat
            got = sum([flat[p] for p in features(word)])
            if len(word) <= 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[word] = got
        return got


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))
