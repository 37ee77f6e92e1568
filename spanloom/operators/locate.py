"""Finding excerpts in documents: exact, then folded; and the relational cores of document reconstruction."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled


def anchored(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, needle, doc_id, text) of all pairs that may match: no pair of an item and a document is looked at
    unless the document has the item's longest inner word, which any containing document has as a whole word.

    Only ids and words are matched; texts are fetched for the pairs that are left.  Items of fewer than three words have
    no inner word and meet all documents; they are expected to be few.
    """
    split = lambda c: F.filter(F.split(c, "[ \\t\\n\\r]+"), lambda w: w != "")
    words = split("needle")
    inner = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2))
    anchor = F.reduce(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    rows = items.select("item_id", "needle", anchor.alias("anchor"))
    there = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\t\\n\\r]+"))).alias("anchor"))
    hits = there.join(rows.where("anchor <> ''"), "anchor").select("item_id", "needle", "doc_id")
    hits = hits.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "needle", "doc_id", "text")
    short = rows.where("anchor = ''")
    return hits.unionByName(short.select("item_id", "needle").join(docs.select("doc_id", "text"), F.expr("locate(needle, text) > 0")))


def exact(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, start, end): the first place of each excerpt in every document that holds it."""
    at = F.expr("locate(needle, text)")
    found = anchored(items, docs).select("item_id", "doc_id", (at - 1).alias("start"), F.length("needle").alias("n")).where("start >= 0")
    return found.select("item_id", "doc_id", "start", (F.col("start") + F.col("n")).alias("end"))


def folded(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that hold an excerpt once quotes, dashes, case and white space are folded."""
    i = items.select("item_id", T.fold(F.col("needle")).alias("needle"))
    d = docs.select("doc_id", T.fold(F.col("text")).alias("text"))
    return anchored(i, d).where("locate(needle, text) > 0").select("item_id", "doc_id")


def match_kinds(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, kind): ``exact`` before ``folded`` before ``none``."""
    e = exact(items, docs).select("item_id", F.lit(1).alias("e")).distinct()
    f = folded(items, docs).select("item_id", F.lit(1).alias("f")).distinct()
    kind = F.when(F.col("e") == 1, "exact").when(F.col("f") == 1, "folded").otherwise("none")
    return items.join(e, "item_id", "left").join(f, "item_id", "left").select("item_id", kind.alias("kind"))


def occurrences(text: Column, needle: Column) -> Column:
    """All places of a needle, overlapping ones included; none of an empty one."""

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, needles: pd.Series) -> pd.Series:
        def of(t: str | None, n: str | None) -> list[int] | None:
            if t is None or n is None:
                return None
            out, at = [], t.find(n) if n else -1
            while at >= 0:
                out.append(at)
                at = t.find(n, at + 1)
            return out

        return pd.Series([of(t, n) for t, n in zip(texts, needles)], dtype=object)

    return places(text, needle)


def longest_alias(rows: DataFrame, most: int = 50) -> DataFrame:
    """Rows (text, aliases, ...) with ``alias``, the longest of the aliases that the text has in any case (ties to the
    lesser), and ``starts``, its first ``most`` places; rows without one go."""
    known = F.filter("aliases", lambda a: (F.coalesce(a, F.lit("")) != "") & F.lower("text").contains(F.lower(a)))
    best = F.array_min(F.transform(known, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))["a"]
    found = rows.withColumn("alias", best).where("alias is not null")
    return found.withColumn("starts", F.slice(occurrences(F.lower("text"), F.lower("alias")), 1, most))


def rebuilt(rows: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """(key, order, start, end): where each piece lies once a key's pieces are joined by ``gap`` characters."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return rows.select(key, order, start.alias("start"), (start + F.length(text)).alias("end"))


def joined(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text): a key's pieces in order, joined by blank lines."""
    whole = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(whole, lambda r: r[text]), "\n\n").alias("text"))


def section_ends(heads: DataFrame, key: str) -> DataFrame:
    """(key, pos, level, end_pos): the next position whose level is not deeper; null at the end.

    A window cannot compare levels, so each key's heads are joined by range on themselves."""
    h = heads.select(key, "pos", "level")
    n = h.select(F.col(key).alias("k"), F.col("pos").alias("p"), F.col("level").alias("l"))
    later = h.join(n, (F.col(key) == F.col("k")) & (F.col("p") > F.col("pos")) & (F.col("l") <= F.col("level")), "left")
    return later.groupBy(key, "pos", "level").agg(F.min("p").alias("end_pos"))


def covering_span(ranges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(range_id, start, end): characters of the mapped tokens from ``first`` up to, not including, ``stop``."""
    on = (F.col("t.doc") == F.col("r.doc")) & (F.col("t.token") >= F.col("r.first")) & (F.col("t.token") < F.col("r.stop"))
    return ranges.alias("r").join(tokens.alias("t"), on).groupBy("r.range_id").agg(F.min("t.start").alias("start"), F.max("t.end").alias("end"))


def holding_block(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """(point_id, block): the first block that a point lies in, both edges counted."""
    on = (F.col("p.doc") == F.col("b.doc")) & (F.col("p.at") >= F.col("b.start")) & (F.col("p.at") <= F.col("b.end"))
    return points.alias("p").join(blocks.alias("b"), on).groupBy("p.point_id").agg(F.min("b.block").alias("block"))


def as_of(log: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, at, value): the latest logged value no later than each asked time."""
    l = log.select(F.col(key).alias("k"), "ts", "value")  # noqa: E741
    hit = asked.join(l, (F.col(key) == F.col("k")) & (F.col("ts") <= F.col("at")), "left")
    return hit.groupBy(key, "at").agg(F.max_by("value", "ts").alias("value"))


def chain_ends(moves: DataFrame) -> DataFrame:
    """(source, final): where each page stands after all moves; null if its moves run in a circle.

    Pointers double every round, and each round is written to the checkpoint folder.  After as many doublings as the
    number of moves has binary digits, only circles still point at a page that moves."""
    now = settled(moves.select("source", F.col("target").alias("final")))
    for _ in range(now.count().bit_length()):
        hop = now.select(F.col("source").alias("final"), F.col("final").alias("next"))
        new = now.join(hop, "final", "left").select("source", F.coalesce("next", "final").alias("final"), F.col("next").isNotNull().alias("moved"))
        new = settled(new)
        going = new.where("moved").limit(1).count()
        now = new.select("source", "final")
        if not going:
            return now
    still = now.select(F.col("source").alias("final"), F.lit(1).alias("circle"))
    return now.join(still, "final", "left").select("source", F.when(F.col("circle").isNull(), F.col("final")).alias("final"))


def retagged(cleaned: list[str], tagged: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    """(tag, line) of cleaned lines, an ordered subsequence of the stripped lines of (tag, line) pairs.  Once a line is
    not found the alignment is lost: it and all that follow have no tag."""
    rest = iter(tagged)
    return [(next((tag for tag, raw in rest if raw.strip() == line), None), line) for line in cleaned]


def with_tags(docs: DataFrame, key: str) -> DataFrame:
    """(key, line, tag, text) for documents (key, cleaned array<string>, tagged array<struct<tag, text>>), a document at
    a time in Arrow batches."""

    def run(batches):
        for b in batches:
            out = []
            for k, cleaned, tagged in zip(*(b.column(i).to_pylist() for i in range(3))):
                out += [(k, i, tag, line) for i, (tag, line) in enumerate(retagged(cleaned or [], [(t["tag"], t["text"]) for t in tagged or []]))]
            cols = list(zip(*out)) or [[]] * 4
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [key, "line", "tag", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "cleaned", "tagged").mapInArrow(run, f"{key} {kind}, line int, tag string, text string")


def section_spans(heads: DataFrame, key: str) -> DataFrame:
    """As :func:`section_ends`, with a stack over each key's heads in one pass: for keys with many heads."""

    def run(batches):
        for b in batches:
            out = []
            for k, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stack: list[tuple[int, int]] = []
                for h in own:
                    while stack and stack[-1][1] >= h["level"]:
                        pos, level = stack.pop()
                        out.append((k, pos, level, h["pos"]))
                    stack.append((h["pos"], h["level"]))
                out += [(k, pos, level, None) for pos, level in stack]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int32(), pa.int64()))], [key, "pos", "level", "end_pos"])

    own = F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("level").cast("int").alias("level"))))
    packed = heads.groupBy(key).agg(own.alias("own"))
    return packed.mapInArrow(run, f"{key} {heads.schema[key].dataType.simpleString()}, pos long, level int, end_pos long")


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """(item_id): items, in order, that are taken while the set of documents they need fits a budget; an item whose
    new documents do not fit is passed over.  The state depends on every earlier choice, so the table of items (ids and
    document ids only) is walked in one task."""
    packed = rows.groupBy("item_id").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))

    def walk(pdf):
        import pandas as pd

        have: set[int] = set()
        keep = []
        for item, docs in sorted(zip(pdf["item_id"], pdf["docs"])):
            new = set(docs) - have
            if len(have) + len(new) <= budget:
                have |= new
                keep.append(item)
        return pd.DataFrame({"item_id": keep})

    return packed.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(walk, "item_id long")
