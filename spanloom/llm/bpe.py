"""Byte-level BPE: overlapping chunks are pre-tokenised apart and stitched where their boundaries meet again.

A match of the pattern depends on what follows its start, never on what precedes it.  So two walks over one text that
reach the same boundary agree from there on.  A long text is cut into chunks of ``chunk`` characters that run ``overlap``
characters into the next; every chunk is walked by itself, in any task; the boundaries near its cut end, where a match
could have read further, are dropped; and the walk of the text passes from one chunk to the next at the first boundary
that both have.  If the overlap holds none (one endless run of letters, say), the walk goes on across the cut from its
last sure boundary.  The stitched pieces are then encoded, each once per worker; decoding joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, numbered_copies

CHUNK, OVERLAP = 32_768, 1_024
#: Characters past its end that a match may have looked at: one for the white-space rule, two for the contractions.
AHEAD = 4
#: Pieces whose ids a worker remembers.
REMEMBERED = 400_000


class Codec:
    """Encoder and decoder over the ranks of a tiktoken vocabulary file and a pre-tokeniser pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, lines))}
        self.tokens: list[bytes | None] = [None] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.names = list(map(str, range(len(self.tokens))))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        if (got := self.known.get(text)) is None:
            got = self._merge(text.encode())
            if len(text) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = got
        return got

    def _merge(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if len(data) > 200:
            return _merge_long(data, self.ranks)
        parts, ranks, none = [data[i : i + 1] for i in range(len(data))], self.ranks, 1 << 60
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)  # the leftmost of equal ranks
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text, chunk, overlap):
            out += self.piece(p)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def ends(self, text: str) -> list[int]:
        """Where the matches of a chunk end."""
        return [m.end() for m in self.pattern.finditer(text)]

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
        if len(text) <= chunk + overlap:
            return iter(self.pattern.findall(text))
        return self.stitched(text, [(at, self.ends(text[at : at + chunk + overlap])) for at in range(0, len(text), chunk)], chunk, overlap)

    def stitched(self, text: str, walks: list[tuple[int, list[int]]], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[str]:
        """Pieces of a text from the walks (start, ends within the chunk) of its chunks, in order of start."""
        last = 0
        for at, ends in walks:
            if at + chunk >= len(text) or at + chunk + overlap >= len(text):
                sure = [at + e for e in ends]
            else:
                sure = [at + e for e in ends if e <= chunk + overlap - AHEAD]
            if at:
                # a boundary is where a match may start too, so the chunk's own start does not count
                i = bisect_left(sure, last)
                while i == len(sure) or sure[i] != last:
                    if last >= at + chunk + overlap or last >= len(text):
                        break
                    m = self.pattern.match(text, last)
                    yield m[0]
                    last = m.end()
                    i = bisect_left(sure, last)
                if i == len(sure) or sure[i] != last:
                    continue
                sure = sure[i + 1 :]
            for e in sure:
                yield text[last:e]
                last = e
        while last < len(text):
            m = self.pattern.match(text, last)
            yield m[0]
            last = m.end()


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The merges of :meth:`Codec._merge` with a heap over a linked list, for pieces of many bytes."""
    import heapq

    n = len(data)
    end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(data[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = nxt[i]
    return tuple(out)


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def _digest(c: Codec, pieces: Iterator[str], ids_too: bool = False) -> dict:
    """Figures of a text's ids and of the bytes that they decode to; the ids of a block of pieces at a time."""
    n, names, back, ids = 0, hashlib.sha256(), hashlib.sha256(), []
    while some := list(islice(pieces, 8192)):
        got = list(map(c.known.get, some))
        if None in got:
            got = [c.piece(p) if g is None else g for p, g in zip(some, got)]
        block = list(chain.from_iterable(got))
        names.update((("," if n else "") + ",".join(map(c.names.__getitem__, block))).encode())
        back.update(c.decode(block))
        n += len(block)
        if ids_too:
            ids += block
    return {"n_tokens": n, "ids_sha256": names.hexdigest(), "decoded_sha256": back.hexdigest(), "ids": ids}


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of ``docs`` (doc_id, text; others ignored).

    A null or empty text has no tokens; its digests are those of no bytes.  Special tokens' strings are ordinary text.
    Repeated rows are returned as often as they come; a long text that repeats is walked once.  ``path`` must be readable
    on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk + overlap
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def short_rows(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = b["doc_id"].to_pylist()
            for at in range(0, len(ids), 512):
                got = [_digest(c, iter(c.pattern.findall(t)), with_ids) for t in b["text"].slice(at, 512).to_pylist()]
                yield {"doc_id": ids[at : at + 512]} | {k: [g[k] for g in got] for k in names[1:]}

    def walk(batches):
        c = codec(path, pattern)
        for b in batches:
            yield b | {"ends": [c.ends(t) for t in b["part"].to_pylist()]}

    def stitch(group):
        """One text's chunks."""
        import pyarrow as pa

        c = codec(path, pattern)
        rows = sorted(zip(group["at"].to_pylist(), group["part"].to_pylist(), group["ends"].to_pylist()), key=lambda r: r[0])
        text = "".join(r[1][:chunk] for r in rows)
        got = _digest(c, c.stitched(text, [(r[0], r[2]) for r in rows], chunk, overlap), with_ids)
        kinds = [("doc_id", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
        one = {"doc_id": [group["doc_id"][0].as_py()], "copies": [group["copies"][0].as_py()]} | {k: [got[k]] for k in names[1:]}
        return pa.table(one, schema=pa.schema(kinds))

    short = in_arrow(docs.where(~long), short_rows, schema)
    cut = docs.where(long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("text_key", F.sha2("text", 256))
    cut = cut.select("doc_id", "copies", "text_key", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("at"))
    cut = cut.select("doc_id", "copies", "text_key", "at", F.expr(f"substring(text, at + 1, {chunk + overlap})").alias("part"))
    walked = in_arrow(cut.repartition("text_key", "at"), walk, "doc_id long, copies long, text_key string, at int, part string, ends array<int>")
    stitched = walked.groupBy("doc_id", "text_key").applyInArrow(stitch, schema.replace("doc_id long, ", "doc_id long, copies long, "))
    return short.unionByName(numbered_copies(stitched, "copies", "copy", ["doc_id", "ids_sha256"]).select(*names))
