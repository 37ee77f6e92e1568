"""Exact top-k inner products over an impact-ordered index, score at a time.

The integer components of the vectors are postings (vector, component, value).  Their impact, the absolute value, is
quantised to powers of two: segment ``level`` holds the impacts in ``[2 ** (level - 1), 2 ** level)``.  An index block
holds some thousand vectors as arrays of postings, ordered by segment from high impact to low and by component in a
segment, and for each vector the length (norm) that is left below each segment.  Queries take one segment after the
other, a batch at a time: each posting adds its value times the queries' weights to its vector's scores.  What is still
missing of a score is at most the lesser of (the query's length times the vector's length that is left) and (the sum of
the query's absolute weights times the next segment's highest impact).  A segment is the last one only if these bounds
prove that few vectors can still reach the k best known so far, which later blocks inherit from earlier ones; the
possible members are then scored again, exactly, from whole vectors.  Queries that no bound can cut are processed to the
last segment.

Queries and vectors meet in tiles of a bounded size: a task holds the index of at most ``GROUP`` blocks, built there from
packed vectors, and lets at most ``QUERY_GROUP`` query blocks pass it one by one.  Only packed vectors travel, those of an
index once for each ``QUERY_GROUP`` query blocks.  The k best of a query are kept per tile and merged by a grouped top-k.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_arrow, stored

#: Vectors of an index block, and queries of a block; both hold fewer if that makes more than ``COMPONENTS`` components.
BLOCK, QUERIES, COMPONENTS = 8192, 1024, 1 << 19
#: Index blocks that a task holds at most, tiles to aim at before it holds more than one, query blocks that pass a tile;
#: partitions that tiles are dealt to at most.
GROUP, TILES, QUERY_GROUP, PARTITIONS = 16, 48, 128, 4096
#: Queries that take a segment together; they stop once one in ``REST`` of their scores at most is open.
BATCH, REST = 256, 32


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, x): ``floor(scale * component)`` with components as doubles; vectors that are null or hold a null or
    non-finite component, and rows without an id, are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("x"))


def _packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, rows) with about ``size`` vectors in a block, however often one is repeated; and the number of blocks."""
    rows = stored(rows)
    count, components = rows.agg(F.count("*"), F.sum(F.size("x"))).first()
    n = max(1, -(-count // size), -(-(components or 0) // COMPONENTS))
    # the place of a row in the written table, so that repeated rows spread
    keyed = rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block"), F.struct("vec_id", "x").alias("row"))
    return keyed.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows")), n


def _narrow(blocks: DataFrame) -> DataFrame:
    """(block, width, item, ids, whole) of (block, rows): vectors as bytes of the narrowest integers that hold them."""

    def run(batches):
        for b in batches:
            for i in range(len(b["rows"])):
                ids, x = _unpacked(b["rows"][i].values)
                lo, hi = int(x.min(initial=0)), int(x.max(initial=0))
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
                yield {"block": b["block"].slice(i, 1), "width": [x.shape[1]], "item": [np.dtype(kind).itemsize], "ids": [ids.astype(np.int64).tobytes()], "whole": [x.astype(kind).tobytes()]}

    return in_arrow(blocks, run, "block int, width int, item int, ids binary, whole binary")


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, padded with zeros, of an Arrow list of (vec_id, x)."""
    ids, x = rows.field("vec_id").to_numpy(), rows.field("x")
    sizes = x.value_lengths().to_numpy()
    flat = x.flatten().to_numpy()
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return ids, out


def _exact(m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``m`` as doubles if all inner products with ``other`` stay exact in them, else as Python integers."""
    most = lambda a: float(np.abs(a.astype(np.float64)).max(initial=0))
    return m.astype(np.float64 if most(m) * most(other) * max(1, m.shape[1]) < 2**52 else object)


class Best:
    """The ``k`` best (position of the query, id, score) of some queries so far: by score, ties to lesser ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.ids, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: Each query's k-th best score, rounded down; that, or a lesser one, may also come from elsewhere.
        self.kth = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.score, score)))
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda j: (query[j], -score[j], ids[j])), int)
        else:
            order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.ids, self.score = query[kept], ids[order][kept], score[order][kept]
        last = place[kept] == self.k - 1
        kth = self.score[last].astype(np.float64)
        self.kth[self.query[last]] = np.maximum(self.kth[self.query[last]], kth - np.abs(kth) * 2.0**-50)


class Segments:
    """An index block: ids, whole vectors, and their postings in segments of descending quantised impact.

    ``row``, ``dim`` and ``value`` are the postings; segment i, of level ``levels[i]``, is ``cuts[i]:cuts[i + 1]``, in lists
    of one component each (``lists[i]``: component, start, end); ``left[i]`` is each vector's length below it.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        row, dim = np.nonzero(vectors)
        value = vectors[row, dim].astype(np.float64)
        level = np.frexp(np.abs(value))[1]
        order = np.lexsort((dim, -level))
        row, dim, value, level = row[order], dim[order], value[order], level[order]
        levels, starts = np.unique(-level, return_index=True)
        self.levels, self.cuts = -levels, np.append(starts, len(level))
        left = np.zeros((len(levels), len(ids)))
        for i in range(len(levels) - 2, -1, -1):  # from the lowest segment up: sums of squares of what follows
            lo, hi = self.cuts[i + 1], self.cuts[i + 2]
            left[i] = left[i + 1] + np.bincount(row[lo:hi], value[lo:hi] ** 2, len(ids))
        self.left = np.sqrt(left)
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        narrow = lambda a, small, large, most: a.astype(small if np.abs(a).max(initial=0) < most else large)
        self.row, self.dim = narrow(row, np.int16, np.int32, 2**15), narrow(dim, np.int16, np.int32, 2**15)
        self.value = narrow(value, np.float32, np.float64, 2**24)
        heads = np.flatnonzero((np.diff(level, prepend=0) != 0) | (np.diff(dim, prepend=-1) != 0)) if len(level) else starts
        ends = np.append(heads, len(level))[1:]
        self.lists = [[(int(dim[a]), int(a), int(b)) for a, b in zip(heads, ends) if lo <= a < hi] for lo, hi in zip(self.cuts, self.cuts[1:])]

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> "Segments":
        return cls(ids, vectors)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (its id in ``own`` is no answer) the ids and scores of its k best, ties to lesser ids."""
        best = Best(len(own), k)
        self.improve(best, queries, own)
        return [(best.ids[best.query == i], best.score[best.query == i]) for i in range(len(own))]

    def improve(self, best: Best, queries: np.ndarray, own: np.ndarray) -> None:
        """Adds to ``best`` of the queries what this block has for them."""
        width = max(self.vectors.shape[1], queries.shape[1])
        whole = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
        asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        whole, asked = _exact(whole, asked), _exact(asked, whole)
        for lo in range(0, len(own), BATCH):
            self._batch(best, lo, whole, asked[lo : lo + BATCH], own[lo : lo + BATCH])

    def _batch(self, best: Best, first: int, whole: np.ndarray, asked: np.ndarray, own: np.ndarray) -> None:
        m, n, width = len(self.ids), len(own), asked.shape[1]
        q = asked.astype(np.float64)
        one, two = np.abs(q).sum(1), np.sqrt((q**2).sum(1))
        # sums in single precision where they cannot overflow; the bounds hold what their rounding may cost
        kind = np.float32 if two.max(initial=0) * self.length.max(initial=0) < 2.0**100 else np.float64
        slack = self.length * (width + 8) * float(np.finfo(kind).eps)
        weights = np.ascontiguousarray(q.T, dtype=kind)
        score = np.zeros((m, n), kind)
        self_row, self_query = self._same(own)
        score[self_row, self_query] = -np.inf
        half, open_ = np.median(self.length) / 2 if m else 0, None
        for i in range(len(self.levels)):
            for dim, lo, hi in self.lists[i] if width else ():
                score[self.row[lo:hi]] += self.value[lo:hi, None].astype(kind, copy=False) * weights[dim]
            end = i + 1 == len(self.levels)
            kth = best.kth[first : first + n]
            if not np.isfinite(kth).all() and m > best.k and (end or np.median(self.left[i]) <= half):
                self._guess(kth, score, whole, asked, best.k)
            if not (end or np.isfinite(kth).all()):
                continue
            open_ = np.multiply.outer((self.left[i] * (1 + 1e-5) + slack).astype(kind), two.astype(kind))
            top = 0.0 if end else 2.0 ** self.levels[i + 1]
            np.minimum(open_, ((one * top) * (1 + 1e-5) + two * slack.max()).astype(kind), out=open_)
            open_ += score
            with np.errstate(over="ignore"):
                open_ = open_ >= (kth - np.abs(np.where(np.isfinite(kth), kth, 0)) * 4 * float(np.finfo(kind).eps)).astype(kind)
            if np.count_nonzero(open_) * REST <= m * n:
                break  # proven: nothing else can be among the k best
        if open_ is None:
            open_ = np.ones((m, n), bool)
        open_[self_row, self_query] = False
        row, query = np.nonzero(open_)
        step = max(1, COMPONENTS // max(1, width))
        for lo in range(0, len(row), step):
            r, c = row[lo : lo + step], query[lo : lo + step]
            exact = _products(whole[r], asked[c])
            near = exact >= best.kth[c + first]
            best.add(c[near] + first, self.ids[r[near]], exact[near])

    def _same(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of the same id."""
        order = np.argsort(self.ids, kind="stable")
        lo, hi = (np.searchsorted(self.ids[order], own, side) for side in ("left", "right"))
        found = [(order[a:b], j) for j, (a, b) in enumerate(zip(lo, hi)) if a < b]
        return np.concatenate([r for r, _ in found] or [np.zeros(0, int)]), np.repeat([j for _, j in found], [len(r) for r, _ in found]).astype(int)

    @staticmethod
    def _guess(kth: np.ndarray, score: np.ndarray, whole: np.ndarray, asked: np.ndarray, k: int) -> None:
        """Raises ``kth`` to the least exact score of the k vectors that lead so far: the k-th best cannot be less."""
        at = np.argpartition(score, len(score) - k, axis=0)[-k:]
        sound = np.isfinite(np.take_along_axis(score, at, 0)).all(0)
        for j in np.flatnonzero(sound):
            least = float(_products(whole[at[:, j]], asked[j]).min())
            kth[j] = max(kth[j], least - abs(least) * 2.0**-50)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; exact, as :func:`_exact` has chosen their type."""
    return (a * b).sum(-1) if a.dtype == object and a.shape[-1] else np.einsum("...i,...i->...", a.astype(np.float64), b.astype(np.float64))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of ``vectors``, by score, ties to the lesser vec_id.

    Both tables hold (vec_id, x) as :func:`whole_vectors` makes them.  A query's own id is no answer; a query with fewer
    candidates gets all.  Vectors of different lengths are compared as if padded with zeros.  Rows that repeat a vec_id
    are candidates one by one; a repeated query id is searched once (with the least of its vectors).
    """
    queries = queries.groupBy("vec_id").agg(F.min("x").alias("x"))
    left, n_left = _packed(queries, query_block)
    right, n_right = _packed(vectors, block)
    # every index block meets every query block: a stated query set against all rows, in tiles
    group = min(GROUP, -(-n_right // TILES))
    rows, columns = -(-n_right // group), -(-n_left // QUERY_GROUP)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = ["asks", "block", "width", "item", "ids", "whole"]
    index = _narrow(right).withColumn("asks", F.lit(False)).select(F.floor(F.col("block") / group).cast("int").alias("v"), to(columns).alias("q"), *packed)
    asked = _narrow(left).withColumn("asks", F.lit(True)).select(to(rows).alias("v"), F.floor(F.col("block") / QUERY_GROUP).cast("int").alias("q"), *packed)
    # more partitions than tiles, so that few get two; in each, a tile's index comes before its queries
    tiles = index.unionByName(asked).repartition(min(PARTITIONS, 4 * rows * columns), "v", "q").sortWithinPartitions("v", "q", "asks", "block")

    def run(batches):
        tile, held = None, []
        for b in batches:
            for i in range(len(b["ids"])):
                at, asks, width, item = (b["v"][i].as_py(), b["q"][i].as_py()), b["asks"][i].as_py(), b["width"][i].as_py(), b["item"][i].as_py()
                if at != tile:
                    tile, held = at, []
                ids = np.frombuffer(b["ids"][i].as_buffer(), np.int64)
                x = np.frombuffer(b["whole"][i].as_buffer(), f"i{item}").reshape(len(ids), width)
                if not asks:
                    held.append(Segments.of(ids.copy(), x.copy()))
                    continue
                best = Best(len(ids), k)
                for part in held:
                    part.improve(best, x, ids)
                score = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in best.score], np.int64)
                yield {"query_id": ids[best.query], "vec_id": best.ids, "score": score}

    found = in_arrow(tiles, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
