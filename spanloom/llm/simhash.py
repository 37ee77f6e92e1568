"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits by pigeonring filtering.

The four 16-bit segments of a fingerprint form a ring.  If two fingerprints differ in at most three bits, then there is
a segment from which every chain of l = 1..4 consecutive segments differs in at most l * 3 / 4 bits: 0, 1, 2, 3.  So the
pair shares one segment whole and differs in at most one bit of the next.  Each distinct fingerprint is entered under
(segment, next segment) once and looked up under the 17 values of the next segment within one bit; the chains of three
and four segments are then tested before the full Hamming check.  Rows grow in proportion to distinct fingerprints.

A key with many fingerprints is refined by the chain of three segments (at most two differing bits): there 48 bits are
fixed, so at most 65,536 distinct fingerprints meet, however many documents there are.  Within a key, lookups stream by
in blocks; what leaves is a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linededup
from ._common import binary, checkpointed, fresh, in_arrow, stored
from .components import connected_components

SEED, BITS = 42, 3
#: Fingerprints under one key of two segments beyond which the key takes a third.
HOT = 4096
#: MinHash bands of a text, and minima of each, where links by similarity are asked for.
DOC_BANDS, DOC_ROWS = 16, 4
_U = np.uint64


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, ASCII-lower-cased; a text of fewer words has one, itself."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, _U)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), _U, max(1, len(words) - width + 1))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles (ASCII-lower-cased; XXH64, seed 42); 0 without a word."""
    return _folded(_hashes(text, width))


def _folded(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in binary(b["text"])), _U, len(b["text"]))
            yield {"doc_id": b["doc_id"], "fp": fps.view(np.int64)}

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _segments(fps: np.ndarray, first: int) -> list[np.ndarray]:
    """The four 16-bit segments in ring order from ``first``."""
    return [(fps >> _U(16 * ((first + k) % 4))) & _U(0xFFFF) for k in range(4)]


def _flips(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)], _U)


#: Differences of segment i + 1 alone, and of i + 1 (low bits) with i + 2, that the chain budgets 1 and 2 leave.
_NEXT = _flips(16, 1)
_NEXT2 = np.array([x for x in _flips(32, 2) if bin(int(x) & 0xFFFF).count("1") <= 1], _U)


def _keys(fps: DataFrame, depth: int) -> DataFrame:
    """(key, hop, probe, fp): each fingerprint once as an entry and once for each value it looks up."""

    def run(batches):
        for b in batches:
            whole = np.asarray(b["fp"]).view(_U)
            for at in range(0, len(whole), 2048 if depth == 2 else 64):
                x = whole[at : at + (2048 if depth == 2 else 64)]
                for i in range(4):
                    s = _segments(x, i)
                    key = s[0] | s[1] << _U(16) if depth == 2 else s[0] | s[1] << _U(16) | s[2] << _U(32)
                    flips = (_NEXT if depth == 2 else _NEXT2) << _U(16)
                    looked = (key[:, None] ^ flips[None, :]).ravel()
                    yield {
                        "key": np.concatenate([key, looked]).view(np.int64),
                        "hop": np.full(len(key) + len(looked), 10 * depth + i, np.int8),
                        "probe": np.repeat([False, True], [len(key), len(looked)]),
                        "fp": np.concatenate([x, np.repeat(x, len(flips))]).view(np.int64),
                    }

    return in_arrow(fps, run, "key long, hop byte, probe boolean, fp long")


def _near(probes: np.ndarray, entries: np.ndarray, hop: int) -> np.ndarray:
    """Pairs within the budgets of the chains of two and three segments and of the whole ring."""
    first = hop % 10
    diff = [np.bitwise_count(p[:, None] ^ e[None, :]) for p, e in zip(_segments(probes, first), _segments(entries, first))]
    chain = diff[0] + diff[1]
    ok = (diff[0] == 0) & (chain <= 1)
    chain = chain + diff[2]
    ok &= chain <= 2
    return ok & (chain + diff[3] <= BITS)


def _forest(batches: Iterator[dict]) -> Iterator[dict]:
    """Spanning edges (a, b) from rows sorted by key, entries before lookups; the rows of a key may span batches."""
    at, entries, parent = None, [], None

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def merged() -> list[tuple[int, int]]:
        return [(entries[i], entries[root(i)]) for i in range(len(entries)) if root(i) != i] if parent else []

    for b in batches:
        keys, hops, probe, fps = (np.asarray(b[c]) if c != "probe" else b[c].to_numpy(zero_copy_only=False) for c in ("key", "hop", "probe", "fp"))
        if not len(keys):
            continue
        out: list[tuple[int, int]] = []
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (hops[1:] != hops[:-1])) + 1
        starts, ends = [0, *cut.tolist()], [*cut.tolist(), len(keys)]
        for lo, hi in zip(starts, ends):
            if (k := (int(keys[lo]), int(hops[lo]))) != at:
                out += merged()
                at, entries, parent = k, [], None
            n = int((~probe[lo:hi]).sum())
            if n:
                entries += fps[lo : lo + n].tolist()
            if lo + n == hi or not entries:
                continue
            if parent is None:
                parent = list(range(len(entries)))
            known = np.array(entries, np.int64)
            looked = fps[lo + n : hi]
            for i in range(0, len(looked), 1024):
                part = looked[i : i + 1024]
                for p, got in _matches(part, known, k[1]):
                    if p != entries[got[0]]:
                        out.append((p, entries[got[0]]))
                    for j in got[1:]:
                        x, y = root(got[0]), root(j)
                        parent[max(x, y)] = min(x, y)
        if out:
            x = np.array(out, np.int64)
            yield {"a": x[:, 0], "b": x[:, 1]}
    if out := merged():
        x = np.array(out, np.int64)
        yield {"a": x[:, 0], "b": x[:, 1]}


def _matches(probes: np.ndarray, known: np.ndarray, hop: int) -> Iterator[tuple[int, list[int]]]:
    if len(known) == 1 and len(probes) == 1 and probes[0] == known[0]:
        return
    found: dict[int, list[int]] = {}
    for at in range(0, len(known), 4096):
        p, e = np.nonzero(_near(probes.view(_U), known[at : at + 4096].view(_U), hop))
        for i, j in zip(p.tolist(), (e + at).tolist()):
            found.setdefault(i, []).append(j)
    for i, got in found.items():
        yield int(probes[i]), got


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are within three bits of each other."""
    fps = fps.select("fp").distinct()
    two = _keys(fps, 2)
    hot = two.where("not probe").groupBy("key", "hop").count().where(F.col("count") > HOT).select("key", "hop")
    if hot.limit(1).count():
        hot = checkpointed(hot)
        again = two.join(hot, ["key", "hop"], "left_semi").select("fp").distinct()
        rows = two.join(hot, ["key", "hop"], "left_anti").unionAll(_keys(again, 3))
    else:
        rows = two
    rows = rows.repartition("key", "hop").sortWithinPartitions("key", "hop", "probe")
    return in_arrow(rows, _forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Fingerprints within three bits link; ``component_id`` is the least doc_id of the component.  A null or empty text,
    or one of white space, has fingerprint zero and links like any other.  Rows with a null doc_id take part and get
    the component's least known doc_id, or null if it has none.  Repeated rows are returned as often as they come.
    """
    return _labelled(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, fps: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """``fps`` with each fingerprint's component; ``more`` has links (a, b) beyond those of few differing bits."""
    rows = checkpointed(fingerprints(docs)) if fps is None else fps
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(distinct) if more is None else links(distinct).unionAll(more)
    member = connected_components(edges).select(F.col("node").alias("fp"), "root")
    member = member.unionByName(member.select("root").distinct().select(F.col("root").alias("fp"), "root")).join(distinct, "fp")
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = member.join(whole, "root").select("fp", "root", "component_id")
    known = distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(known, "fp")


def _whole(text: str | None) -> Iterator[tuple[int, str]]:
    """A text with a word as the one piece of itself."""
    if text and text.encode("utf-8", "surrogatepass").split():
        yield 0, text


def _similar_texts(docs: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between the fingerprints of texts whose sets of word shingles have that Jaccard similarity or more."""

    def sets(texts: list[str]) -> Iterator[np.ndarray]:
        return (np.unique(_hashes(t.encode("utf-8", "surrogatepass"), width)) for t in texts)

    edges = checkpointed(linededup.linked(docs, rows, _whole, sets, DOC_BANDS, similarity))
    of = rows.where("bands is not null").select("id", "fp")
    of = checkpointed(of.join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").distinct())
    a, b = of.select(F.col("id").alias("a"), F.col("fp").alias("x")), of.select(F.col("id").alias("b"), F.col("fp").alias("y"))
    return edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def keep_one(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate group, with all columns of ``docs``.

    Texts link whose fingerprints, of shingles of ``width`` words, are within three bits.  That stands for far more than
    a Jaccard similarity of 0.8, so with ``similarity`` texts also link whose sets of shingles are that similar: MinHash
    bands (16 of 4: a pair at 0.8 shares one with probability 0.9998) bring them together, and the sets are compared
    exactly.  Of each group the row of the least doc_id stays (null doc_ids last; of that doc_id's texts in the group,
    the least MD5), once even if the row is repeated; of rows alike in both, the one of the least MD5 over its columns.
    """
    mark = fresh(docs.columns, "text_key")
    keyed = docs.withColumn(mark, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))

    def run(batches):
        for b in batches:
            texts = binary(b["text"])
            at = 0
            while at < len(texts):
                some, n, lo = [], 0, at
                while at < len(texts) and n < linededup.CHARS:
                    some.append(_hashes(texts[at], width))
                    n += len(some[-1])
                    at += 1
                out = {c: b[c].slice(lo, at - lo) for c in ("doc_id", "text_key")}
                out["fp"] = pa.array(np.fromiter(map(_folded, some), _U, len(some)).view(np.int64))
                out["id"], out["bands"], out["sketch"] = ([None] * len(some) for _ in range(3))
                if similarity is not None and n:
                    full = [i for i, h in enumerate(some) if len(h)]
                    starts = np.cumsum([0, *(len(some[i]) for i in full[:-1])])
                    keys, sketches = linededup._signed(np.concatenate(some), starts, DOC_BANDS, DOC_ROWS)
                    for i, row, mine in zip(full, keys, sketches.view(np.int64).tolist()):
                        out["id"][i], out["bands"][i], out["sketch"][i] = xxhash.xxh3_128_digest(texts[lo + i]), row.tobytes(), mine
                yield out

    slim = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(mark).alias("text_key"))
    rows = stored(in_arrow(slim, run, "doc_id long, text_key string, fp long, id binary, bands binary, sketch long"))
    more = None if similarity is None else _similar_texts(docs, rows, width, similarity)
    labelled = _labelled(docs, rows.select("doc_id", "text_key", "fp"), more)
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), F.col("doc_id").isNull(), F.col("text_key"))
    best = labelled.groupBy("root").agg(F.min(order).alias("o"))
    best = best.select(F.when(~F.col("o.col2"), F.col("o.col1")).alias("_doc"), F.col("o.text_key").alias("_key"))
    picked = keyed.join(best, keyed["doc_id"].eqNullSafe(best["_doc"]) & (keyed[mark] == best["_key"]), "left_semi")
    whole = F.struct(*[picked[c] for c in docs.columns])
    one = picked.groupBy("doc_id", mark).agg(F.min_by(whole, F.md5(F.to_json(whole).cast("binary"))).alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
