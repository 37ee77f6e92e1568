"""Comparing runs: best settings, pivots, differences, rank correlation and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(runs: DataFrame, keys: list[str], metric: str = "value", tie: str = "params") -> DataFrame:
    """The row with the highest metric of each group; nulls last, ties to the lesser ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), tie)
    return runs.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")


def difference_to(runs: DataFrame, reference: str) -> DataFrame:
    """(method, datasets, difference): mean over datasets of a method's value less the reference method's."""
    ref = F.max(F.when(F.col("method") == reference, F.col("value"))).over(Window.partitionBy("dataset"))
    return runs.withColumn("ref", ref).groupBy("method").agg(F.count("value").alias("datasets"), F.round(F.avg(F.col("value") - F.col("ref")), 6).alias("difference"))


def spearman(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, rho): correlation of average ranks."""
    def average_rank(c):
        first = F.rank().over(Window.partitionBy(key).orderBy(c))
        return first + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2.0

    ranks = rows.select(key, average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    return ranks.groupBy(key).agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


def run_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value_a, value_b, difference) with all keys of ``a``."""
    left, right = a.select(key, F.col(value).alias("value_a")), b.select(key, F.col(value).alias("value_b"))
    return left.join(right, key, "left").select(key, "value_a", "value_b", F.round(F.col("value_a") - F.col("value_b"), 6).alias("difference"))


def cost_summary(costs: DataFrame, n: int) -> DataFrame:
    """(name, total, mean, median) of long costs (name, value) of ``n`` records: a missing cost counts as 0 in the mean;
    medians of seconds only."""
    middle = F.when(F.col("name").endswith("seconds"), F.col("m"))
    rows = costs.groupBy("name").agg(F.round(F.sum("value"), 3).alias("total"), F.round(F.sum("value") / n, 6).alias("mean"), F.round(F.median("value"), 6).alias("m"))
    return rows.select("name", "total", "mean", middle.alias("median"))


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table: missing values as a dash, decimals to three places."""
    def cell(v) -> str:
        return "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)

    rows = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
