"""Interval algebra over half-open character spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): unions of the spans of each key; touching spans merge."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.select(*keys, "start", "end", F.when(F.col("start") <= reach, 0).otherwise(1).alias("new"))
    rows = rows.select(*keys, "start", "end", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` whose span overlaps one of ``right`` with the same keys; touching is no overlap."""
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    on = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    for k in keys:
        on &= F.col(k) == F.col(f"r_{k}")
    return left.join(r, on, how)


def shared_length(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shared): characters that the unions of both sides have in common."""
    both = overlapping(merged(left, keys), merged(right, keys), keys, "inner")
    return both.groupBy(*keys).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))


def total_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    return merged(spans, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
