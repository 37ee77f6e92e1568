"""Run summaries and the tables that compare them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def added_up(records: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, total) of a column of maps: sums by name, to three places."""
    return records.select(*keys, F.explode(column).alias("name", "value")).groupBy(*keys, "name").agg(F.round(F.sum("value"), 3).alias("total"))


def method_label(rendering: Column, method: Column, augmentations: Column) -> Column:
    """``rendering, method +augmentation ...``"""
    return F.concat(rendering, F.lit(", "), method, F.array_join(F.transform(augmentations, lambda a: F.concat(F.lit(" +"), a)), ""))


def params_label(params: Column) -> Column:
    """``key=value, ...`` of a map, in its order."""
    return F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def shown_group(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of long metrics (keys, grp, ...) the rows of the group that is shown: evidence where a run has it, else the other."""
    has = F.max(F.when(F.col("grp") == "evidence", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return metrics.withColumn("has", has).where("(has = 1) = (grp = 'evidence')").drop("has")


def cost_cell(name: Column, value: Column) -> Column:
    """A cost as shown: tokens whole with separators, seconds to three significant figures, a dash for none."""
    digits = F.greatest(F.lit(0), 2 - F.floor(F.log10(F.abs(value)))).cast("int")
    seconds = F.when(value == 0, "0").otherwise(F.regexp_replace(F.format_string("%s", F.round(value, 6).cast("decimal(38,6)")), r"\.?0+$", ""))
    short = F.regexp_replace(F.concat(F.lit(""), F.bround(value * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), r"\.0$", "")
    return F.when(value.isNull(), "–").when(name.contains("tok"), F.format_number(value, 0)).when(F.abs(value) < 1000, F.when(value == 0, seconds).otherwise(short)).otherwise(F.format_number(value, 0))


def index_cost(runs: DataFrame, stages: DataFrame, indexes: DataFrame) -> DataFrame:
    """(run, llm_tokens, seconds, embed_tokens), a document's mean, for runs (run, chunks, documents) from ``stages`` (run,
    stage, documents, seconds, llm_tokens, embedding_tokens) and ``indexes`` (run, chunks, seconds, embedding_tokens).

    Embedding is counted by the chunk.  Without stages nothing is known; without an index's cost only the LLM's tokens."""
    part = lambda c: F.sum(F.col(c) / F.col("documents"))
    built = stages.groupBy("run").agg(part("llm_tokens").alias("llm"), part("seconds").alias("s"), part("embedding_tokens").alias("e"))
    each = indexes.select("run", (F.col("seconds") / F.col("chunks")).alias("is"), (F.coalesce("embedding_tokens", F.lit(0)) / F.col("chunks")).alias("ie"))
    rows = runs.join(built, "run", "left").join(each, "run", "left").withColumn("per", F.col("chunks") / F.col("documents"))
    r = lambda c: F.round(c, 6)
    return rows.select("run", r(F.col("llm")).alias("llm_tokens"), r(F.col("s") + F.col("is") * F.col("per")).alias("seconds"), r(F.col("e") + F.col("ie") * F.col("per")).alias("embed_tokens"))


def baseline(runs: DataFrame, retrieval: str = "dense", top_k: int = 50, embedding: str = "bge-m3") -> DataFrame:
    """Runs around whose chunking everything is plain: that retrieval and embedding, no reranking, no augmentation."""
    plain = (F.col("retrieval") == retrieval) & (F.col("top_k") == top_k) & (F.col("embedding") == embedding)
    return runs.where(plain & F.col("reranking").isNull() & (F.size("augmentations") == 0))


def differs(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, differs): whether a group's rows do not agree in some columns."""
    return rows.groupBy(*keys).agg((F.count_distinct(F.struct(*columns)) > 1).alias("differs"))


def table_rows(rows: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str]) -> DataFrame:
    """Rows with ``place`` in their table: the metric from high to low, none last, then the tie columns."""
    order = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), *tie)
    return rows.withColumn("place", F.row_number().over(order))


def extremes(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, least, most): the names with the least and the highest value; ties to the lesser name."""
    low, high = F.struct(value, name), F.struct(-F.col(value), name)
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(name, low).alias("least"), F.min_by(name, high).alias("most"))


def context_recall(statements: DataFrame) -> DataFrame:
    """(item_id, value): the share of statements (item_id, attributed) that are; null for an item without any."""
    return statements.groupBy("item_id").agg(F.round(F.avg(F.col("attributed").cast("int")), 6).alias("value"))


def judge_sample(items: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """(item_id) still to be judged: of the first ``n`` items with an answer in the order of the SHA-1 of their ids, those
    without a verdict that stands (a failed one is asked for again)."""
    first = items.where(F.coalesce("answer", F.lit("")) != "").orderBy(F.sha1(F.col("item_id").cast("string").cast("binary"))).limit(n)
    return first.select("item_id").join(verdicts.where("error is null"), "item_id", "left_anti")


def with_judgement(summaries: DataFrame, entry: DataFrame) -> DataFrame:
    """Summaries (run, judged map<string, double>) with an entry (run, judge, k, value) set under ``judge-k=k``; what was
    there under other names stays."""
    new = entry.select("run", F.create_map(F.concat("judge", F.lit("-k="), F.col("k").cast("string")), "value").alias("new"))
    rows = summaries.join(new, "run", "left")
    old = F.coalesce("judged", F.create_map().cast("map<string,double>"))
    merged = F.when(F.col("new").isNull(), F.col("judged")).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("new"), k)), F.col("new")))
    return rows.select(*[merged.alias(c) if c == "judged" else c for c in summaries.columns])


def run_summary(metrics: DataFrame, run: dict, chunks: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of a run: its settings, chunks and their mean length, items left out by reason, and the means of the
    metrics by group, from long metrics (item_id, grp, name, value)."""
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    means = metrics.groupBy("grp", "name").agg(F.round(F.avg("value"), 6).alias("value")).groupBy("grp").agg(pairs("name", "value").alias("m"))
    means = means.agg(pairs("grp", "m").alias("metrics"))
    items = metrics.groupBy("grp").agg(F.count_distinct("item_id").alias("n")).agg(pairs("grp", "n").alias("items"))
    size = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean_chunk_chars"))
    left = skipped.groupBy("reason").count().agg(pairs("reason", "count").alias("skipped"))
    settings = metrics.sparkSession.createDataFrame([(*map(str, run.values()),)], list(run))
    out = settings
    for one_row in (size, items, left, means):
        out = out.join(F.broadcast(one_row))
    return out


def inspected(chunks: DataFrame, asked: str = "", order: str = "natural") -> DataFrame:
    """Chunks that hold ``asked`` in any case, with ``place`` in their document's list: in their ``natural`` order, the
    ``longest`` or the ``shortest`` first, ties in natural order."""
    by = {"natural": [], "longest": [F.length("chunk_text").desc()], "shortest": [F.length("chunk_text")]}
    if order not in by:
        raise ValueError(f"order {order!r} is none of {', '.join(by)}")
    window = Window.partitionBy("doc_id").orderBy(*by[order], "chunk_index")
    rows = chunks.where(F.lower("chunk_text").contains(asked.lower())) if asked else chunks
    return rows.withColumn("place", F.row_number().over(window))
