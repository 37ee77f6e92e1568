"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard verification, distributed union-find.

Lines are cut at ``\\n``; those with a word take part.  Equal lines share a 128-bit id, so only different lines are
compared.  A line's signature has 11 bands of 5 minima over its shingles of 5 characters (one changed character costs 5 of
them, so it is bridged from 49 characters on); at a Jaccard similarity of 0.8 two lines share a band with probability
0.987, at 0.9 with 0.99997.  Beside its band keys a line has a sketch, 4 bits of each of 16 minima: lines of one key go on
only if a line with at least ``AGREE`` equal parts is beside them, which at 0.8 all but one pair in 10,000 have and chance
meetings hardly ever do.  What is left is compared exactly, by sets of shingles.  A key with many lines is dealt out as
pairs of blocks of at most about ``BLOCK`` lines, so that no task gathers it; within a pair, a line is compared with a
component only until it has joined it, and only a spanning forest leaves.  Of each component of similar lines the first
line in the order of (doc_id, line number) stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, fresh, in_arrow, stored
from .components import connected_components

WIDTH, BANDS, ROWS, SIMILARITY = 5, 11, 5, 0.8
#: Minima in a sketch, and how many must agree.
SKETCH, AGREE = 16, 7
#: Characters that are hashed at a time: the arrays stay in a core's cache.
CHARS = 1 << 16
#: Lines of a block of a key's lines.
BLOCK = 256
#: Bits of the filter that keeps most lines that no other resembles from being shuffled; 8 MB whatever the input.
FILTER_BITS = 26
_A = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) * (i * i + 3)) % 2**64 | 1 for i in range(64)], np.uint64)
_P = np.uint64(0x100000001B3)
_SPACES = " \t\n\v\f\r"


def _shingles(lines: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of some lines, one line after the other, and where each line's begin.

    A line shorter than a shingle has one: itself.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.concatenate([code, np.zeros(width, np.uint64)])
    h = np.zeros(len(code) - width, np.uint64)
    for i in range(width):
        h *= _P
        h += code[i : i + len(h)]
    ends = np.cumsum(lengths)
    counts = np.maximum(1, lengths - width + 1)
    keep = np.ones(len(h), bool)
    for i in range(1, width):  # windows that run into the next line
        keep[(ends - i)[lengths >= i]] = False
    for i in np.flatnonzero(lengths < width).tolist():
        at = ends[i] - lengths[i]
        h[at] = xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass"), 7)
        keep[at] = True
    h = h[keep]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """MinHash band keys, a row of ``BANDS`` for each (non-empty) line, and sketches."""
    got = [_signed(*_shingles(part)) for part in _parts(lines)]
    return (np.concatenate([k for k, _ in got]), np.concatenate([s for _, s in got])) if got else (np.empty((0, BANDS), np.uint64), np.empty(0, np.uint64))


def _parts(lines: list[str]) -> Iterator[list[str]]:
    """Some lines at a time, of about ``CHARS`` characters."""
    at = 0
    while at < len(lines):
        stop, chars = at, 0
        while stop < len(lines) and chars < CHARS:
            chars += len(lines[stop])
            stop += 1
        yield lines[at:stop]
        at = stop


def _signed(h: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketches of sets of hashes that begin at ``starts``; 64 minima at most."""
    out, mixed = np.empty((len(starts), bands), np.uint64), np.empty_like(h)
    sketch, taken = np.zeros(len(starts), np.uint64), 0
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            low = np.minimum.reduceat(np.multiply(h, _A[b * rows + r], out=mixed), starts)
            key = (key ^ (low >> np.uint64(17))) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(31)
            # the first minimum of every band, then the second of the first bands
            if r == 0 or r == 1 and b < SKETCH - bands:
                if taken < SKETCH:
                    sketch |= ((low >> np.uint64(20)) & np.uint64(15)) << np.uint64(4 * taken)
                taken += 1
        out[:, b] = key
    return out, sketch


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many parts of two sketches are equal."""
    x = a ^ b
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return SKETCH - np.bitwise_count(x)


def _handle(name: bytes) -> int:
    """The first half of a 128-bit id, as a signed number."""
    return int.from_bytes(name[:8], "big", signed=True)


def _of(text: str | None) -> Iterator[tuple[int, str]]:
    for i, line in enumerate((text or "").split("\n")):
        if line.strip(_SPACES):
            yield i, line


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, id, bands, sketch) for each line; ``bands`` and ``sketch`` are null where a task met the line
    before.  A text without lines has one row, of line -1 and a null id."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            ids, at = b["doc_id"].to_pylist(), 0
            while at < len(ids):
                doc, key, no, names, new = [], [], [], [], []
                chars = 0
                while at < len(ids) and chars < 16 * CHARS:
                    text = b["text"][at].as_py()
                    mark = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) - 2**63
                    before = len(names)
                    for i, line in _of(text):
                        name = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        doc.append(ids[at])
                        key.append(mark)
                        no.append(i)
                        names.append(name)
                        if name not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(name)
                            new.append((len(names) - 1, line))
                    if len(names) == before:
                        doc.append(ids[at])
                        key.append(mark)
                        no.append(-1)
                        names.append(None)
                    chars += len(text or "")
                    at += 1
                bands, sketch = [None] * len(names), [None] * len(names)
                if new:
                    keys, sketches = signatures([line for _, line in new])
                    for (i, _), row, mine in zip(new, keys, sketches.view(np.int64).tolist()):
                        bands[i], sketch[i] = row.tobytes(), mine
                if names:
                    yield {"doc_id": doc, "text_key": key, "line": no, "id": names, "bands": bands, "sketch": sketch}

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, text_key long, line int, id binary, bands binary, sketch long")


def _shared_keys(occurrences: DataFrame, bands: int = BANDS) -> DataFrame:
    """(key, id) of the band keys that two or more different lines have whose sketches agree; ``id`` is a line's handle."""

    def spread(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b["bands"].to_pylist()), np.int64)
            ids = np.fromiter(map(_handle, b["id"].to_pylist()), np.int64, len(b["id"]))
            yield {"key": keys, "id": np.repeat(ids, bands), "sketch": np.repeat(np.asarray(b["sketch"]), bands)}

    def whole_keys(batches):
        """Arrays of key, id and sketch that do not cut a key's rows."""
        held: list[tuple] = []
        for b in batches:
            now = tuple(np.asarray(b[c]) for c in ("key", "id", "sketch"))
            if not len(now[0]):
                continue
            if held and now[0][0] == now[0][-1] == held[-1][0][-1]:
                held.append(now)
                continue
            now = tuple(np.concatenate([h[i] for h in [*held, now]]) for i in range(3))
            cut = int(np.searchsorted(now[0], now[0][-1]))
            yield tuple(x[:cut] for x in now)
            held = [tuple(x[cut:] for x in now)]
        if held:
            yield tuple(np.concatenate([h[i] for h in held]) for i in range(3))

    def runs(batches):
        for key, name, sketch in whole_keys(batches):
            # equal lines of a key follow each other
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, name, sketch = key[first], name[first], sketch[first].view(np.uint64)
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            many = same[:-1] | same[1:]
            key, name, sketch = key[many], name[many], sketch[many]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            near = np.zeros(len(key), bool)
            two = starts[sizes == 2]
            near[two] = near[two + 1] = _agree(sketch[two], sketch[two + 1]) >= AGREE
            for lo, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                mine = sketch[lo : lo + n]
                if n > 4096:  # a key of so many lines is no chance meeting
                    near[lo : lo + n] = True
                    continue
                for i in range(0, n, 256):
                    meet = _agree(mine[i : i + 256, None], mine[None, :]) >= AGREE
                    near[lo + i : lo + min(n, i + 256)] = meet.sum(1) > 1  # each agrees with itself
            if near.any():
                yield {"key": key[near], "id": name[near]}

    rows = in_arrow(occurrences.where("bands is not null").select("id", "bands", "sketch"), spread, "key long, id long, sketch long")
    rows = rows.repartition("key").sortWithinPartitions("key", "id")
    return in_arrow(rows, runs, "key long, id long")


def _texts(docs: DataFrame, wanted: DataFrame, pieces: Callable = _of) -> DataFrame:
    """(id, name, text) of lines (or other pieces of a text), all of those whose handles are in ``wanted`` among them; a
    line comes once.

    A filter of a fixed size keeps most others back; where it is full, all lines come, and the join that follows is
    exact all the same.
    """
    place = F.col("place")
    at = F.shiftright("id", 4).bitwiseAND(2**FILTER_BITS - 1)
    words = wanted.select(at.alias("place")).groupBy(F.shiftright(place, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int"))).alias("bits"))
    got = words.toArrow()  # at most 2**21 rows
    filled = np.zeros(2 ** (FILTER_BITS - 5), np.uint32)
    filled[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        bits, seen = sent.value, set()
        for b in batches:
            for lo in range(0, len(b["text"]), 256):
                ids, names, lines = [], [], []
                for text in b["text"].slice(lo, 256).to_pylist():
                    for _, line in pieces(text):
                        name = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        at = _handle(name)
                        place = (at >> 4) & (2**FILTER_BITS - 1)
                        if bits[place >> 5] >> (place & 31) & 1 and name not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(name)
                            ids.append(at)
                            names.append(name)
                            lines.append(line)
                if ids:
                    yield {"id": ids, "name": names, "text": lines}

    found = in_arrow(docs.select(F.col("text").cast("string")), run, "id long, name binary, text string")
    return found.repartition("id").groupBy("id", "name").agg(F.first("text").alias("text"))


def _sets(lines: list[str]) -> Iterator[np.ndarray]:
    """Each line's set of shingles, sorted."""
    for some in _parts(lines):
        h, starts = _shingles(some)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
            part = np.sort(h[lo:hi])
            yield part[np.concatenate([[True], part[1:] != part[:-1]])]


def _similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    joined = np.sort(np.concatenate([a, b]), kind="stable")  # merges the two sorted runs
    both = int(np.count_nonzero(joined[1:] == joined[:-1]))
    return both >= least * (len(a) + len(b) - both)


def _verified(batches: Iterator[dict], sets: Callable = _sets, least: float = SIMILARITY) -> Iterator[dict]:
    """Edges (a, b) of names from rows (key, x, y, block, name, text) sorted by (key, x, y, name): of block pairs of a key."""
    at = last = None
    members: list[tuple[int, bytes, np.ndarray]] = []
    parent: list[int] = []
    out: list[tuple[bytes, bytes]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in batches:
        rows = zip(*(b[c].to_pylist() for c in ("key", "x", "y", "block", "name")), sets(b["text"].to_pylist()))
        for key, x, y, block, name, mine in rows:
            if (key, x, y) != at:
                at, members, parent, last = (key, x, y), [], [], None
            if name == last:
                continue
            last = name
            me = len(members)
            members.append((block, name, mine))
            parent.append(me)
            # the latest first: neighbours of one component mostly resemble each other
            for i in range(me - 1, -1, -1):
                if (x == y or members[i][0] != block) and root(i) != root(me) and _similar(mine, members[i][2], least):
                    parent[root(me)] = root(i)
                    out.append((name, members[i][1]))
        if out:
            yield {"a": [o[0] for o in out], "b": [o[1] for o in out]}
            out = []


def similar_lines(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(node, root): line ids and the least id of their component, for lines that are similar to a different one."""
    return connected_components(linked(docs, occurrences))


def linked(docs: DataFrame, occurrences: DataFrame, pieces: Callable = _of, sets: Callable = _sets, bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) of ids, enough to connect all pieces whose sets are similar, from (id, bands, sketch) of each.

    Handles, half an id, find candidates: should two different lines share one, both are compared, under their ids.
    """
    shared = checkpointed(_shared_keys(occurrences, bands))
    groups = shared.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"))
    # keys of one set of lines need one comparison
    groups = groups.groupBy("n", "s").agg(F.min("key").alias("key")).select("key", "n")
    shared = checkpointed(shared.join(groups, "key"))
    text = _texts(docs, shared.select("id").distinct(), pieces)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = shared.join(text, "id").select("key", "name", "text", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "name", "text")
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "name")
    return in_arrow(rows, partial(_verified, sets=sets, least=least), "a binary, b binary")


def line_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_lines, removed, kept_in) for each distinct (doc_id, text): its lines with a word, the sorted
    numbers (from 0, blank lines counted) of those that leave, and for each of these the (doc_id, line) that stays.

    Null, empty and blank texts have no lines and lose none.  Rows alike in doc_id and text are one document: they lose
    the same lines.  Null doc_ids come last in the order in which a component's line is chosen.
    """
    lines = stored(_occurrences(docs))
    member = similar_lines(docs, lines).withColumnRenamed("node", "id")
    lines = lines.select("doc_id", "text_key", "line", "id").join(member, "id", "left")
    lines = checkpointed(lines.select("doc_id", "text_key", "line", F.coalesce("root", "id").alias("root")))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "line")
    best = lines.where("root is not null").groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    leaves = F.when(F.col("best").isNotNull() & (place != F.col("best")), F.struct("line", F.col("best.doc_id").alias("doc_id"), F.col("best.line").alias("kept")))
    out = lines.join(best, "root", "left").select("doc_id", "text_key", "line", leaves.alias("gone"))
    # identical rows bring a line number more than once
    out = out.groupBy("doc_id", "text_key").agg(F.count_distinct(F.when(F.col("line") >= 0, F.col("line"))).alias("n_lines"), F.sort_array(F.collect_set("gone")).alias("gone"))
    kept = F.transform("gone", lambda g: F.struct(g["doc_id"].alias("doc_id"), g["kept"].alias("line")))
    return out.select("doc_id", "text_key", "n_lines", F.col("gone.line").alias("removed"), kept.alias("kept_in"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the same rows and columns, the texts without the lines that leave.

    A text that loses all lines with a word keeps its blank ones; nulls stay null.  A column ``n_chars`` follows the text.
    """
    key, gone = fresh(docs.columns, "text_key"), fresh(docs.columns, "removed")
    names, types = docs.columns, docs.schema
    d = line_decisions(docs).select("doc_id", "text_key", "removed").where("size(removed) > 0").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias(key), F.col("removed").alias(gone))

    def mark(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            marks = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) - 2**63 for t in texts]
            yield b.append_column(key, pa.array(marks, pa.int64()))

    keyed = docs.mapInArrow(mark, docs.select("*", F.lit(0).cast("long").alias(key)).schema)
    joined = keyed.join(d, keyed["doc_id"].cast("long").eqNullSafe(d["_doc"]) & (keyed[key] == d[key]), "left")
    joined = joined.select(*[keyed[c] for c in names], d[gone])

    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            left = b.schema.get_field_index(gone)
            texts, n = b.column(at).cast(pa.string()).to_pylist(), b.column(left).to_pylist()
            texts = [t if not r else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set_) for t, r, set_ in ((t, r, set(r or ())) for t, r in zip(texts, n))]
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            i = b.schema.get_field_index("n_chars")
            if i >= 0:
                sizes = [len(t) if r else old for t, r, old in zip(texts, n, b.column(i).to_pylist())]
                b = b.set_column(i, b.schema.field(i), pa.array(sizes, b.schema.field(i).type))
            yield b.select([c for c in b.schema.names if c != gone])

    return joined.mapInArrow(cut, types)
