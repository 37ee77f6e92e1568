"""Models as plain callables over columns, with deterministic defaults that need no network.

Any of them can be replaced by an Arrow UDF of the same shape; operators take them as arguments.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

TextModel = Callable[[Column], Column]


def first_sentence(text: Column) -> Column:
    """Stub for titles and summaries."""
    return F.trim(F.regexp_extract(text, r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1))


def frequent_terms(text: Column, n: int = 8) -> Column:
    """Stub for keywords: the first ``n`` different terms of five or more characters."""
    return F.array_join(F.slice(F.array_distinct(F.filter(T.terms(text), lambda t: F.length(t) >= 5)), 1, n), ", ")


def lexical_overlap(query: Column, text: Column) -> Column:
    """Stub cross-encoder: the share of the query's different terms that the text has."""
    q = F.array_distinct(T.terms(query))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, T.terms(text))) / F.size(q))


def overlap_judge(question: Column, answer: Column, contexts: Column) -> Column:
    """Stub judge, ``struct(context_precision, context_recall, error)``: a context is useful if it has half of the answer's
    terms; precision is the average over useful contexts of the share of useful ones so far, recall the share of the
    answer's terms that any context has.  An answer without terms is an error, as a value."""
    useful = F.transform(contexts, lambda c: F.when(lexical_overlap(answer, c) >= 0.5, 1.0).otherwise(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    upto = F.transform(useful, lambda x, i: x * total(F.slice(useful, F.lit(1), i + 1)) / (i + 1))
    known = F.size(T.terms(answer)) > 0
    precision = F.round(total(upto) / (total(useful) + 1e-10), 6)
    recall = F.round(lexical_overlap(answer, F.array_join(contexts, "\n")), 6)
    error = F.when(known.isNull() | ~known, F.lit("the answer has no terms"))
    return F.struct(F.when(known, precision).alias("context_precision"), F.when(known, recall).alias("context_recall"), error.alias("error"))


def chars_counter(text: Column) -> Column:
    """Token count by characters: a quarter, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def words_counter(text: Column) -> Column:
    """Token count by words: 1.2 a word, half to even."""
    return F.bround(F.lit(1.2) * T.n_words(text)).cast("int")


_TERM = re.compile(r"\w{2,}")


@lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def hashed_words(texts: list[str], width: int = 64) -> np.ndarray:
    """Stub embedding: counts of a text's terms by CRC-32 modulo ``width``."""
    found = [list(map(_hashed, _TERM.findall(t.lower()))) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    at = np.fromiter(chain.from_iterable(found), np.int64, len(row)) % width
    return np.bincount(row * width + at, minlength=len(texts) * width).astype(float).reshape(len(texts), width)


#: The vector of texts joined by white space is the sum of theirs.
hashed_words.adds_up = True


class BpeTokens:
    """Tokens of a byte-level BPE vocabulary file; ``path`` must be readable on every executor, where it is opened once."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._codec = path, pattern, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_codec": None}

    @property
    def codec(self):
        if self._codec is None:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            self._codec = tiktoken.Encoding("bpe", pat_str=self.pattern, mergeable_ranks=load_tiktoken_bpe(self.path), special_tokens={})
        return self._codec

    def count(self, text: str) -> int:
        return len(self.codec.encode_ordinary(text))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Tokens as spans of characters, for chunkers; a character that tokens share belongs to the first, and tokens
        that have none of their own are left out."""
        starts = self.codec.decode_with_offsets(self.codec.encode_ordinary(text))[1] if text else []
        edges = [*dict.fromkeys(starts), len(text)]
        return list(zip(edges, edges[1:]))

    def truncate(self, text: str, most: int) -> tuple[str, bool]:
        """The text up to at most ``most`` tokens, without a character that is cut, and whether anything is gone."""
        ids = self.codec.encode_ordinary(text)
        if len(ids) <= most:
            return text, False
        return self.codec.decode_bytes(ids[: max(0, most)]).decode("utf-8", "ignore"), True

    def fit(self, query: str, documents: list[str], most: int, special: int = 2) -> list[tuple[str, bool]]:
        """Documents cut so that each makes a pair with the query, and the pair's special tokens, within ``most``."""
        left = most - self.count(query) - special
        return [self.truncate(d, left) for d in documents]

    def counter(self) -> TextModel:
        """The count as a column function."""
        tokens = self

        @F.pandas_udf("int")
        def count(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: tokens.count(t or "")).astype("int32")

        return count

    def truncated(self, text: Column, most: int) -> Column:
        """``struct(text, cut)`` of a column."""
        tokens = self

        @F.pandas_udf("text string, cut boolean")
        def cut(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([tokens.truncate(t or "", most) for t in texts], columns=["text", "cut"])

        return cut(text)
