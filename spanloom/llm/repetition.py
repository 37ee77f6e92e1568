"""Quality rules on repetition: characters inside duplicated word n-grams and lines, from rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary, in_arrow

#: Most share of a text's word characters inside duplicated n-grams, by n; and inside duplicated lines.
COVERAGE = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
LINES = 0.20
SYMBOLS = b"#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of ``n`` words."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        h = h * _MIX + words[i : i + len(h)]
    return h


def _covered(h: np.ndarray, n: int, n_words: int) -> np.ndarray | None:
    """Which words lie in a window whose hash comes twice or more; None if there is no such window."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measures(text: bytes | None, lengths: Sequence[int] = tuple(n for n, _ in COVERAGE)) -> dict:
    """Counts of a text and the characters that its duplicated n-grams and lines cover."""
    text = text or b""
    words = text.split()
    n = len(words)
    chars = lambda b: len(b) - sum(0x80 <= x < 0xC0 for x in b) if not b.isascii() else len(b)
    raw = np.frombuffer(text, np.uint8)
    n_chars = int(((raw & 0xC0) != 0x80).sum()) - sum(text.count(bytes([c])) for c in _SPACES)
    out = {"n_words": n, "word_chars": n_chars, "n_symbols": sum(text.count(bytes([c])) for c in SYMBOLS), "n_repeat_words": 0}
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += chars(b"".join(line.split()))
        elif line.strip():
            seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_chars}
    # hash() is the same for equal bytes within a process; only equality counts
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    covered: dict[int, int] = dict.fromkeys(lengths, 0)
    size = None
    dry = None  # a length without duplicates; no longer window has any
    for k in sorted({5, *lengths}):
        if n < k or dry:
            break
        inside = _covered(_rolling(ids, k), k, n)
        if inside is None:
            dry = k
            continue
        if size is None:
            size = np.fromiter(map(len, words), np.int64, n) if text.isascii() else np.fromiter((len(w.decode()) for w in words), np.int64, n)
        if k == 5:
            out["n_repeat_words"] = int(inside.sum())
        if k in covered:
            covered[k] = int(size[inside].sum())
    return out | {"covered": covered}


def verdict(m: dict) -> tuple[bool, bool]:
    """(base_failed, kept) of :func:`measures`."""
    failed = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]
    fine = all(m["covered"][n] <= most * m["word_chars"] for n, most in COVERAGE) and m["dup_line_chars"] <= LINES * m["word_chars"]
    return failed, not failed and fine


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup{n}_chars long" for n, _ in COVERAGE)


def rated(docs: DataFrame) -> DataFrame:
    """Counts, coverage and verdict for each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no words and fails the base rule.  Repeated rows are rated one by one.  ``dupN_chars`` are
    the characters of words inside windows of N words that come twice or more in the text, the first included;
    ``dup_line_chars`` the word characters of lines that equal an earlier one.  A text is kept if it passes the base
    rule and no coverage exceeds its share of the word characters.
    """

    def run(batches):
        for b in batches:
            rows = [measures(t) for t in binary(b["text"])]
            out = {c: [r[c] for r in rows] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")}
            says = [verdict(r) for r in rows]
            out |= {f"dup{n}_chars": [r["covered"][n] for r in rows] for n, _ in COVERAGE}
            yield out | {"doc_id": b["doc_id"], "base_failed": [s[0] for s in says], "kept": [s[1] for s in says]}

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, " + _SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([verdict(measures(t))[1] for t in binary(b.column(at).cast(pa.string()))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
