"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source's target is ``least(cap, level * weight)``, where the cap is the source's size times the most epochs and the
level makes the targets share the whole.  Clamping what overflows and sharing the excess by weight until nothing
overflows ends at just that level: ordered by cap / weight, the clamped sources come first.  A source then gives every
document whole as often as the target allows, and once more the documents that come first in a seeded order, up to the
fraction that is left.  That order is cut in slices by the head of the hash, so that no source is sorted as a whole: the
sums of the slices are few, and only the slice in which the fraction ends is ordered by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, checkpointed, fresh, uniform

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 10
#: Slices of a source's seeded order, a power of two.
SLICES = 1 << 12
#: Source plans up to this number go to every task with a broadcast (under 1 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 4096


def n_words(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key(docs: DataFrame) -> Column:
    """A document's place in the seeded order; rows alike in doc_id and text share theirs."""
    return uniform(docs["doc_id"], docs["text"], seed=SEED)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so few rows.

    Sources by code point, null last, take the weights in turn.  All targets share the sum of the sizes; none is above
    ``epochs`` times its source's size.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * float(epochs))
    # ratio at which a source clamps; the exact products are compared as the sources stand in this order
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.select("*", F.sum("source_size").over(whole).alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"), F.sum("w").over(after).alias("left"))
    rows = rows.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    # the level is that of the first source that does not clamp; every one before it clamps
    rows = rows.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole))
    return rows.select("source", "source_size", F.least("cap", F.col("final.level") * F.col("w")).alias("target"))


def plan(slim: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, last_key) from rows (source, size, key): how often each document is taken
    whole, and up to which key (or null) once more."""
    shift = 60 - (SLICES.bit_length() - 1)
    part = slim.groupBy("source", F.shiftright("key", shift).alias("slice")).agg(F.sum("size").alias("part"))
    part = checkpointed(part)
    goal = targets(part.groupBy("source").agg(F.sum("part").alias("source_size")), weights, epochs)
    goal = goal.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"))
    goal = goal.select("*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    goal = checkpointed(goal)
    run = Window.partitionBy("source").orderBy("slice")
    edge = part.select("source", "slice", "part", F.sum("part").over(run).alias("upto"))
    edge = edge.withColumnRenamed("source", "s").join(goal, F.col("s").eqNullSafe(F.col("source"))).where("rest > 0")
    edge = edge.where("upto - part < rest").groupBy("source", "rest").agg(F.max_by(F.struct("slice", (F.col("upto") - F.col("part")).alias("before")), "slice").alias("e"))
    edge = edge.select(F.col("source").alias("s"), "rest", F.col("e.slice").alias("sl"), F.col("e.before").alias("before"))
    # rows of one key go together; the slice's rows are a 4,096th of the source's
    fine = slim.join(_small(edge), slim["source"].eqNullSafe(F.col("s")) & (F.shiftright("key", shift) == F.col("sl")))
    fine = fine.groupBy("source", "key", "rest", "before").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("key")
    fine = fine.select("source", "key", "rest", (F.col("before") + F.sum("n").over(run)).alias("upto"), "n")
    # the key at which half of it still fits, so that a source misses its target by half a document at most
    last = fine.groupBy("source").agg(F.max(F.when(F.col("upto") - F.col("n") / 2 <= F.col("rest"), F.col("key"))).alias("in"), F.min("key").alias("least"))
    last = last.select(F.col("source").alias("s"), F.coalesce("in", F.col("least") - 1).alias("last_key"))
    out = goal.join(last, goal["source"].eqNullSafe(last["s"]), "left")
    return checkpointed(out.select("source", "source_size", "target", F.col("whole").cast("long"), "last_key"))


def _small(plan: DataFrame) -> DataFrame:
    """With a broadcast hint if it is proven small."""
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source; others are ignored).

    ``size`` counts words (null text: 0), ``taken`` the words that the mix takes of it: its size times its repetitions,
    ``epochs`` at most.  Rows alike in doc_id and text are taken alike.  A null source is a source.  If all sizes are
    zero, so are the targets.  Reruns agree.
    """
    slim = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(docs["text"].cast("string")).alias("size"), _key(docs).alias("key")))
    p = plan(slim, weights, epochs).withColumnRenamed("source", "s")
    out = slim.join(_small(p), slim["source"].eqNullSafe(p["s"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def _times() -> Column:
    return F.col("whole") + F.when(F.col("key") <= F.col("last_key"), 1).otherwise(0)


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken.

    A document without words is no part of any target; it is kept once.
    """
    size, key, s, times, whole, last = (fresh(docs.columns, n) for n in ("size", "key", "s", "times", "whole", "last"))
    rows = docs.withColumns({size: n_words(docs["text"].cast("string")), key: _key(docs)})
    slim = checkpointed(rows.select(docs["source"].cast("string").alias("source"), F.col(size).alias("size"), F.col(key).alias("key")))
    p = plan(slim, weights, epochs)
    p = p.select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("last_key").alias(last))
    out = rows.join(_small(p), rows["source"].cast("string").eqNullSafe(p[s]))
    n = F.when(F.col(size) == 0, 1).otherwise(p[whole] + F.when(F.col(key) <= p[last], 1).otherwise(0))
    out = out.withColumn(times, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    return out.select(*[out[c] for c in docs.columns])
