"""Ranking metrics against evidence spans and gold documents; judge aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import spans as S

KS = (1, 3, 5, 10)


def gold_documents(evidence: DataFrame, named: DataFrame) -> DataFrame:
    """(item_id, doc_id): the documents of an item's evidence; of an item without any, those that it names."""
    own = evidence.select("item_id", "doc_id").distinct()
    return own.unionByName(named.select("item_id", "doc_id").distinct().join(own, "item_id", "left_anti"))


def per_question(ranking: DataFrame, evidence: DataFrame, items: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS, gold: DataFrame | None = None) -> DataFrame:
    """(item_id, grp, name, value), long: all metrics of every item of ``items`` (item_id).

    ``ranking`` holds (item_id, rank, doc_id, start, end); ``evidence`` (item_id, doc_id, start, end); ``chunks`` the
    index's spans; ``gold`` (item_id, doc_id) the documents that ``doc_hit`` looks for, those of the evidence if none
    are given.  Items without evidence have no span metrics.
    """
    ranking, evidence = kept(ranking), kept(evidence)  # both are small and read several times
    gold = (evidence if gold is None else gold).select("item_id", "doc_id").distinct()
    hits = S.overlapping(ranking, evidence, ["item_id", "doc_id"]).select("item_id", "rank").distinct().withColumn("hit", F.lit(1))
    docs = ranking.join(gold, ["item_id", "doc_id"], "left_semi").select("item_id", "rank").withColumn("doc", F.lit(1))
    marked = ranking.select("item_id", "rank").join(hits, ["item_id", "rank"], "left").join(docs, ["item_id", "rank"], "left")
    found = evidence.select("doc_id", "item_id", F.col("start").alias("s"), F.col("end").alias("e")).join(chunks, "doc_id").where("start < e and s < end")
    relevant = found.groupBy("item_id").agg(F.count_distinct("doc_id", "chunk_index").alias("relevant"))
    aggs = [F.min(F.when((F.col("hit") == 1) & (F.col("rank") <= 10), F.col("rank"))).alias("first")]
    for k in ks:
        upto = F.col("rank") <= k
        aggs += [
            F.max(F.when(upto & (F.col("doc") == 1), 1.0).otherwise(0.0)).alias(f"doc{k}"),
            F.max(F.when(upto & (F.col("hit") == 1), 1.0).otherwise(0.0)).alias(f"hit{k}"),
            F.sum(F.when(upto & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}"),
        ]
    base = items.select("item_id").join(marked.groupBy("item_id").agg(*aggs), "item_id", "left").join(relevant, "item_id", "left")
    total = S.total_length(evidence, ["item_id", "doc_id"]).groupBy("item_id").agg(F.sum("total").alias("total"))
    base = base.join(total, "item_id", "left")
    at = F.explode(F.array(*map(F.lit, ks)))
    cuts = ranking.select(at.alias("k"), "item_id", "doc_id", "rank", "start", "end").where("rank <= k").drop("rank")
    shared = S.shared_length(cuts, evidence.select(at.alias("k"), "item_id", "doc_id", "start", "end"), ["k", "item_id", "doc_id"])
    shared = shared.groupBy("item_id").agg(*[F.sum(F.when(F.col("k") == k, F.col("shared"))).alias(f"shared{k}") for k in ks])
    base = base.join(shared, "item_id", "left")
    out = [F.struct(F.lit(f"doc_hit@{k}").alias("name"), F.coalesce(f"doc{k}", F.lit(0.0)).alias("value")) for k in ks]
    spans = [("mrr@10", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))]
    for k in ks:
        n = F.least(F.lit(k), F.coalesce("relevant", F.lit(0).cast("long"))).cast("int")
        ideal = F.aggregate(F.slice(F.array(*[F.lit(1 / math.log2(r + 1)) for r in range(1, max(ks) + 1)]), 1, n), F.lit(0.0), lambda s, x: s + x)
        spans += [
            (f"hit@{k}", F.coalesce(f"hit{k}", F.lit(0.0))),
            (f"ndcg@{k}", F.when(ideal > 0, F.coalesce(f"dcg{k}", F.lit(0.0)) / ideal).otherwise(0.0)),
            (f"evidence_recall@{k}", F.coalesce(f"shared{k}", F.lit(0)) / F.col("total")),
        ]
    inner = [F.when(F.col("total").isNotNull(), F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))) for n, v in spans]
    grp = F.when(F.col("total").isNotNull(), "evidence").otherwise("no_evidence")
    rows = base.select("item_id", grp.alias("grp"), F.explode(F.array(*out, *inner)).alias("m")).where("m is not null")
    return rows.select("item_id", "grp", F.col("m.name").alias("name"), F.round("m.value", 6).alias("value"))


def marked(ranking: DataFrame, evidence: DataFrame) -> DataFrame:
    """``ranking`` (item_id, rank, doc_id, start, end, ...) with ``evidence``: whether a chunk overlaps a span of its item's."""
    ranking = kept(ranking)  # small, and read twice
    hits = S.overlapping(ranking, evidence, ["item_id", "doc_id"]).select("item_id", "rank", F.lit(True).alias("hit"))
    return ranking.join(hits, ["item_id", "rank"], "left").withColumn("evidence", F.coalesce("hit", F.lit(False))).drop("hit")


def summary(metrics: DataFrame) -> DataFrame:
    """(grp, name, items, value): the mean of every metric, with and without evidence apart."""
    return metrics.groupBy("grp", "name").agg(F.count("*").alias("items"), F.round(F.avg("value"), 6).alias("value"))


def average_precision(verdicts: DataFrame) -> DataFrame:
    """(item_id, value) of ordered binary verdicts (item_id, rank, verdict)."""
    order = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = verdicts.select("item_id", "verdict", (F.sum("verdict").over(order) / F.count("*").over(order)).alias("precision"))
    return at.groupBy("item_id").agg(F.round(F.sum(F.col("verdict") * F.col("precision")) / (F.sum("verdict") + 1e-10), 6).alias("value"))


def judge_summary(verdicts: DataFrame) -> DataFrame:
    """(items, failed, context_precision, context_recall and their counts) of verdicts with nulls and errors."""
    m = ("context_precision", "context_recall")
    return verdicts.agg(F.count("*").alias("items"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[F.round(F.avg(c), 6).alias(c) for c in m], *[F.count(c).alias(f"{c}_n") for c in m])


def eligibility(items: DataFrame) -> DataFrame:
    """(item_id, reason): the first that applies of unanswerable, no_document, not_indexed, not_in_rendering; else keep.

    ``items`` has answerable, docs, indexed (arrays), n_evidence and n_spans (of the rendering)."""
    reason = (F.when(~F.col("answerable"), "unanswerable").when(F.size("docs") == 0, "no_document")
              .when(F.size(F.array_except("docs", "indexed")) > 0, "not_indexed")
              .when((F.col("n_evidence") > 0) & (F.col("n_spans") == 0), "not_in_rendering").otherwise("keep"))
    return items.select("item_id", reason.alias("reason"))


def sampled(items: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items by the SHA-1 of their id: smaller samples are prefixes of larger ones."""
    return items.orderBy(F.sha1(F.col("item_id").cast("string").cast("binary"))).limit(n)
