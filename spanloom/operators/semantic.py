"""Chunkers over embedded sentences: from texts and an embedding provider to chunks, a document at a time.

``embed`` takes a list of texts and gives a matrix with a row for each; see :mod:`spanloom.functions.providers`.  The
rules are those of :func:`chunking.semantic_groups`, :func:`chunking.tiled_boundaries` and :func:`chunking.clustered`,
which work on tables of ready vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..functions import providers
from . import chunking as C

Embed = Callable[[list[str]], np.ndarray]
Spans = list[tuple[int, int]]


def window_texts(text: str, sentences: Spans, before: int, after: int) -> list[str]:
    """For each sentence the text from ``before`` sentences ahead of it to ``after`` behind it, as far as there are any."""
    last = len(sentences) - 1
    return [text[sentences[max(0, i - before)][0] : sentences[min(last, i + after)][1]] for i in range(len(sentences))]


def window_vectors(text: str, sentences: Spans, before: int, after: int, embed: Embed) -> np.ndarray:
    """The vectors of :func:`window_texts`.  Where those of sentences add up to that of their window, and sums of counts are
    exact, each sentence is embedded once, not once for every window that it is in."""
    if not getattr(embed, "adds_up", False):
        return embed(window_texts(text, sentences, before, after))
    n = np.arange(len(sentences))
    own = embed([text[s:e] for s, e in sentences])
    upto = np.concatenate([np.zeros((1, own.shape[1])), np.cumsum(own, axis=0)])
    return upto[np.minimum(n + after + 1, len(n))] - upto[np.maximum(n - before, 0)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distance row by row, to 9 decimals; 1 where a row is zero."""
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    dots = (a * b).sum(1)
    return np.round(1 - np.divide(dots, size, out=np.zeros(len(a)), where=size > 0), 9)


def _percentile(d: np.ndarray, p: float) -> float:
    return round(float(np.percentile(d, p)), 9)


def _cut(sentences: Spans, firsts: list[int]) -> Spans:
    """Chunks that begin with the sentences at ``firsts``."""
    edges = [0, *firsts, len(sentences)]
    return [(sentences[a][0], sentences[b - 1][1]) for a, b in zip(edges, edges[1:])]


def semantic_spans(text: str, embed: Embed, percentile: float = 95, buffer: int = 1, by_line: bool = False) -> Spans:
    """Cuts where the distance between neighbouring groups of sentences is above the document's percentile."""
    sentences = C.sentence_spans(text, by_line)
    if len(sentences) < 2:
        return sentences
    v = window_vectors(text, sentences, buffer, buffer, embed)
    d = distances(v[:-1], v[1:])
    return _cut(sentences, (np.flatnonzero(d > _percentile(d, percentile)) + 1).tolist())


def tiled_spans(text: str, embed: Embed, block: int = 3, percentile: float = 90, neighbourhood: int = 2, by_line: bool = False) -> Spans:
    """Cuts where the block before and the block from a sentence on differ most, locally and overall; a document of at
    most two blocks is one chunk."""
    sentences = C.sentence_spans(text, by_line)
    n = len(sentences)
    if n <= 2 * block:
        return _cut(sentences, []) if sentences else []
    v = window_vectors(text, sentences, 0, block - 1, embed)
    d = distances(v[: n - 2 * block + 1], v[block : n - block + 1])
    least = _percentile(d, percentile)
    return _cut(sentences, [i + block for i in np.flatnonzero(d >= least) if d[i] >= d[max(0, i - neighbourhood) : i + neighbourhood + 1].max()])


def clustered_spans(text: str, embed: Embed, percentile: float = 95, threshold: float | None = None, max_tokens: int = 1024, buffer: int = 1, count: Callable[[str], int] = C.count_words, by_line: bool = False) -> Spans:
    """Runs of sentences, cut at their largest gap while it is above the threshold (the percentile of the document's own
    distances if none is given) or the run holds more than ``max_tokens``."""
    sentences = C.sentence_spans(text, by_line)
    if len(sentences) < 2:
        return sentences
    v = window_vectors(text, sentences, buffer, buffer, embed)
    d = distances(v[:-1], v[1:])
    limit = _percentile(d, percentile) if threshold is None else threshold
    firsts, todo = [], [(0, len(sentences))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            at = lo + int(np.argmax(d[lo : hi - 1]))
            if d[at] > limit or count(text[sentences[lo][0] : sentences[hi - 1][1]]) > max_tokens:
                firsts.append(at + 1)
                todo += [(lo, at + 1), (at + 1, hi)]
    return _cut(sentences, sorted(firsts))


def semantic(docs: DataFrame, embed: Embed = providers.hashed_words, percentile: float = 95, buffer: int = 1, by_line: bool = False, texts: bool = True) -> DataFrame:
    return C.by_document(docs, lambda t: semantic_spans(t, embed, percentile, buffer, by_line), texts)


def tiled(docs: DataFrame, embed: Embed = providers.hashed_words, block: int = 3, percentile: float = 90, neighbourhood: int = 2, by_line: bool = False, texts: bool = True) -> DataFrame:
    return C.by_document(docs, lambda t: tiled_spans(t, embed, block, percentile, neighbourhood, by_line), texts)


def clustered(docs: DataFrame, embed: Embed = providers.hashed_words, percentile: float = 95, threshold: float | None = None, max_tokens: int = 1024, buffer: int = 1, by_line: bool = False, texts: bool = True) -> DataFrame:
    return C.by_document(docs, lambda t: clustered_spans(t, embed, percentile, threshold, max_tokens, buffer, by_line=by_line), texts)
