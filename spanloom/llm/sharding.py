"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split.

A shard is a prefix of the row's hash.  It starts as the empty prefix; a shard whose rows exceed the byte limit splits
on the next bit, others stay.  Whole histograms are summed for ``STEP`` bits at a time, so that one pass settles that
many splits, and only rows of shards that are still too large come into the next pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed, fresh, numbered_copies, uniform

LIMIT, STEP, BITS, SEED = 64 << 20, 12, 60, 4


def _prefix(bits, depth):
    """The leading ``depth`` (a number or column) of 60 bits, as a long."""
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(prefix, depth, base, shard_bytes) of the final shards for rows (key, n_bytes).

    ``prefix`` is the number that the key's leading ``depth`` bits make; ``base`` the bits settled by earlier passes.  A
    shard that one key fills alone stays over the limit at depth 60; :func:`assigned` pages it.
    """
    at, done, base = rows.select("key", F.col("n_bytes").cast("long").alias("n_bytes")), None, 0
    while True:
        deep = base + STEP
        fine = at.groupBy(_prefix(F.col("key"), F.lit(deep)).alias("fine")).agg(F.sum("n_bytes").alias("n"))
        levels = fine.select("n", "fine", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth"))
        up = F.call_function("shiftright", "fine", (F.lit(deep) - F.col("depth")).cast("int"))
        sums = checkpointed(levels.select("depth", "n", up.alias("prefix")).groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        halves = F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1))
        split = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), halves.alias("prefix"))
        whole = F.lit(base == 0) & (F.col("depth") == 0)
        leaf = sums.where(fits & ~whole).join(split, ["depth", "prefix"], "left_semi").unionByName(sums.where(fits & whole))
        leaf = leaf.select("prefix", "depth", F.lit(base).alias("base"), "shard_bytes")
        done = leaf if done is None else done.unionByName(leaf)
        large = sums.where(~fits & (F.col("depth") == deep)).select(F.col("prefix").alias("fine"))
        if deep >= BITS or not large.limit(1).count():
            return checkpointed(done)
        base = deep
        at = at.withColumn("fine", _prefix(F.col("key"), F.lit(base))).join(large, "fine", "left_semi").select("key", "n_bytes")


def _directories(shards: DataFrame) -> DataFrame:
    """(base, parent, local, entries): each pass's directory for a prefix of ``base`` bits, the array that its next
    ``local - base`` bits index.  A shard stands under as many entries as its depth is short of the local one; null
    where no shard of the pass is."""
    start = F.call_function("shiftleft", F.col("prefix"), (F.lit(BITS) - F.col("depth")).cast("int"))
    own = F.struct(start.alias("start"), "depth", "prefix", "shard_bytes")
    parent = F.call_function("shiftright", "prefix", (F.col("depth") - F.col("base")).cast("int"))
    # at most 2**STEP shards in each
    rows = shards.groupBy("base", parent.alias("parent")).agg(F.max("depth").alias("local"), F.sort_array(F.collect_list(own)).alias("own"))
    kind = "array<struct<start:bigint,depth:int,prefix:bigint,shard_bytes:bigint>>"
    gap = F.lit(None).cast(kind[6:-1])
    place = lambda s: _slot(s["start"], F.col("local"), F.col("base")).cast("int")
    spread = lambda s: F.call_function("shiftleft", F.lit(1), (F.col("local") - s["depth"]).cast("int"))
    step = lambda done, s: F.concat(done, F.array_repeat(gap, place(s) - F.size(done)), F.array_repeat(s, spread(s)))
    return rows.select("base", "parent", "local", F.aggregate("own", F.array().cast(kind), step).alias("entries"))


def _slot(bits, local, base):
    """The number that the bits from ``base`` up to ``local`` make."""
    return _prefix(bits, local).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (local - base).cast("int")) - 1)


def _looked_up(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with depth, prefix and shard_bytes, from the directory of the pass that settled each."""
    found = checkpointed(_directories(shards))
    bases = sorted(r[0] for r in found.select("base").distinct().collect()) or [0]  # five at most
    deeper = bases[1:] if bases[0] == 0 else bases
    entry = F.get("entries", _slot(F.col("key"), F.col("local"), F.col("base")).cast("int"))
    done = lambda rows: rows.select(*keys.columns, entry.alias("_shard")).where("_shard is not null").select(*keys.columns, "_shard.depth", "_shard.prefix", "_shard.shard_bytes")
    # the first directory is one row of at most 2**STEP entries
    out = done(keys.withColumn("base", F.lit(0)).join(F.broadcast(found.where("base = 0")), "base"))
    if deeper:
        more = keys.select("*", F.explode(F.array(*[F.lit(b) for b in deeper])).alias("base")).withColumn("parent", _prefix(F.col("key"), F.col("base")))
        out = out.unionByName(done(more.join(found.where("base > 0"), ["base", "parent"])))
    return out


def assigned(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, page, shard_bytes) for each row of ``docs`` (doc_id, text; others ignored).

    ``n_bytes`` is the text's UTF-8 length (null: 0).  The hash is over doc_id and text.  Rows alike in both share it:
    if they alone exceed the limit, their shard, then at the full depth, is paged, and each page fits.  A single
    document over the limit is a page of its own.  ``shard_bytes`` are the shard's before paging.
    """
    same = checkpointed(_slim(docs).groupBy("doc_id", "n_bytes", "key").agg(F.count("*").alias("copies")))
    shards = directory(same.select("key", (F.col("n_bytes") * F.col("copies")).alias("n_bytes")), limit)
    page = F.when((F.col("shard_bytes") > limit) & (F.col("n_bytes") > 0), F.floor(F.col("i") / _per_page(limit))).otherwise(0).cast("long")
    out = numbered_copies(_looked_up(same, shards), "copies", "i", ["key"])
    return out.select("doc_id", "n_bytes", "depth", "prefix", page.alias("page"), "shard_bytes")


def _per_page(limit: int):
    """Rows of ``n_bytes`` that a page takes."""
    return F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))


def _slim(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_bytes"), uniform(docs["doc_id"], docs["text"], seed=SEED).alias("key"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """``docs``, with all columns and ``shard``, as Parquet under ``path``, a folder for each shard that fits the limit.

    ``shard`` is depth-prefix.  Rows alike in doc_id and text that alone exceed the limit are paged, every task's rows by
    themselves: their folders are depth-prefix-task-page.  A single document over the limit has a folder of its own.
    """
    names = ("shard_key", "shard", "n_bytes", "task", "over", "nth")
    key, shard, size, task, over, nth = (fresh(docs.columns, n) for n in names)
    keys = checkpointed(_slim(docs).select("key", "n_bytes"))
    found = _looked_up(keys.select("key").distinct(), directory(keys, limit))
    found = found.select(F.col("key").alias(key), F.concat_ws("-", "depth", "prefix").alias(shard), (F.col("shard_bytes") > limit).alias(over))
    n = F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("long")
    keyed = docs.withColumns({key: uniform(docs["doc_id"], docs["text"], seed=SEED), size: n, task: F.spark_partition_id()})
    out = keyed.join(found, key)
    out = out.select(*[out[c] for c in docs.columns], key, size, task, shard, over)
    fits, large = out.where(~F.col(over)), out.where(F.col(over))
    # a task's rows of one key are as many as its split holds, however often the key comes
    large = large.withColumn(nth, F.row_number().over(Window.partitionBy(task, key).orderBy(size)) - 1)
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col(size), F.lit(1))))
    large = large.withColumn(shard, F.concat_ws("-", shard, task, F.floor(F.col(nth) / per)))
    both = fits.select(*docs.columns, shard).unionByName(large.select(*docs.columns, shard))
    both.repartition(shard).write.partitionBy(shard).parquet(path)
