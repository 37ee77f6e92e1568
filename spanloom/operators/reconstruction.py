"""Relational cores of building documents, items and evidence from raw records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def squeezed_map(text: Column) -> Column:
    """``struct(text, places)``: the text with white space runs as one space and none at the edges, and for each
    character, and the end, where it lands in that."""

    @F.pandas_udf("text string, places array<int>")
    def fold(texts: pd.Series) -> pd.DataFrame:
        def of(t: str) -> tuple[str, list[int]]:
            words = t.split()
            out, at, seen = [], 0, 0
            for w in words:
                start = t.index(w, seen)
                # white space before the first word lands on 0, between words on the space, behind the last on the end
                out += [at] * (start - seen)
                at += bool(at)
                out += range(at, at + len(w))
                at, seen = at + len(w), start + len(w)
            return " ".join(words), out + [at] * (len(t) - seen + 1)

        return pd.DataFrame([of(t or "") for t in texts], columns=["text", "places"])

    return fold(text)


def solid_place(text: Column, needle: Column) -> Column:
    """``struct(start, end)`` of a needle's first place when no white space counts; null if there is none.

    The count of solid characters before the match leads back to offsets: the pattern skips as many."""
    solid = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    n = F.length(solid(needle))
    at = F.position(solid(needle), solid(text)) - 1
    first = lambda pattern: F.length(F.call_function("regexp_extract", text, pattern, F.lit(0)))
    head = lambda k: first(F.concat(F.lit(r"(?U)^(?:\s*\S){"), k.cast("string"), F.lit("}")))
    start = first(F.concat(F.lit(r"(?U)^(?:\s*\S){"), at.cast("string"), F.lit(r"}\s*")))
    return F.when((n > 0) & (at >= 0), F.struct(start.alias("start"), head(at + n).alias("end")))


def located_blocks(paragraphs: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, para, start, end) of paragraphs (keys, para, text) by equality of squeezed text with blocks (keys, start, end,
    text); the first block wins."""
    first = blocks.select(*keys, T.squeeze(F.col("text")).alias("folded"), F.struct("start", "end").alias("at")).groupBy(*keys, "folded").agg(F.min("at").alias("at"))
    rows = paragraphs.select(*keys, "para", T.squeeze(F.col("text")).alias("folded")).join(first, [*keys, "folded"])
    return rows.select(*keys, "para", "at.start", "at.end")


def first_elements(elements: DataFrame, key: str) -> DataFrame:
    """(key, text, pos, ambiguous): an element's first place on its page, and whether it has another."""
    return elements.groupBy(key, "text").agg(F.min("pos").alias("pos"), (F.count("*") > 1).alias("ambiguous"))


def token_blocks(tokens: DataFrame, key: str) -> DataFrame:
    """(key, block, first, last, text): text tokens (key, token, text, kind) between tags; an ``open`` or ``close`` tag
    begins a new block, other tags are left out, and blocks without text are no blocks."""
    order = Window.partitionBy(key).orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("run", F.sum(F.when(F.col("kind").isin("open", "close"), 1).otherwise(0)).over(order)).where("kind = 'text'")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("token", "text"))), lambda t: t["text"]), " ")
    found = rows.groupBy(key, "run").agg(F.min("token").alias("first"), F.max("token").alias("last"), text.alias("text"))
    return found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).alias("block"), "first", "last", "text")


def table_runs(elements: DataFrame, key: str, row_tag: str = "tr") -> DataFrame:
    """Elements (key, pos, tag) with ``run``, the number of their run of table rows, null outside tables."""
    order = Window.partitionBy(key).orderBy("pos")
    row = F.col("tag") == row_tag
    starts = row & ~F.coalesce(F.lag("tag").over(order) == row_tag, F.lit(False))
    run = F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return elements.withColumn("run", F.when(row, run))


def element_parts(element: Column) -> Column:
    """``struct(tag, text)`` of ``<tag>text</tag>``; null for anything else."""
    pattern = r"(?s)^<(\w+)>(.*)</\1>$"
    return F.when(F.btrim(element).rlike(pattern), F.struct(F.regexp_extract(F.btrim(element), pattern, 1).alias("tag"), F.regexp_extract(F.btrim(element), pattern, 2).alias("text")))


def as_markdown(tag: Column, text: Column) -> Column:
    """A block as Markdown: ``#`` by a heading's level, ``- `` for list items, cells between bars for rows."""
    level = F.regexp_extract(tag, r"^h([1-6])$", 1)
    cells = F.array_join(F.filter(F.split(F.regexp_replace(text, r"</?t[dh]>", "\x00"), "\x00"), lambda x: F.btrim(x) != ""), " | ")
    return F.when(level != "", F.concat(F.repeat(F.lit("#"), F.nullif(level, F.lit("")).cast("int")), F.lit(" "), text)).when(tag == "li", F.concat(F.lit("- "), text)).when(tag == "tr", F.concat(F.lit("| "), cells, F.lit(" |"))).otherwise(text)


def plain_quotes(text: Column) -> Column:
    """Typographic quotes made plain and double hyphens a dash."""
    return F.replace(F.translate(text, "‘’“”", "''\"\""), F.lit("--"), F.lit("—"))


def chosen_answer(extractive: Column, free_form: Column, yes_no: Column, unanswerable: Column) -> Column:
    """``struct(answer, kind)``: extracts joined, else the free answer, else yes or no, else unanswerable."""
    made = lambda a, k: F.struct(a.alias("answer"), F.lit(k).alias("kind"))
    return (F.when(F.coalesce(unanswerable, F.lit(False)), made(F.lit("Unanswerable"), "unanswerable"))
            .when(F.size(extractive) > 0, made(F.array_join(F.transform(extractive, lambda x: F.btrim(x)), "; "), "extractive"))
            .when(free_form != "", made(free_form, "abstractive"))
            .when(yes_no.isNotNull(), made(F.when(yes_no, "Yes").otherwise("No"), "yes_no"))
            .otherwise(made(F.lit("Unanswerable"), "unanswerable")))


def first_answer(annotations: Column) -> Column:
    """The first annotation whose ``kind`` is not unanswerable; null if all are."""
    return F.get(F.filter(annotations, lambda x: x["kind"] != "unanswerable"), F.lit(0))


def unprefixed(evidence: Column, prefix: str) -> Column:
    """``struct(kept, dropped)``: evidence texts without those of a prefix, and how many those are."""
    kept = F.filter(evidence, lambda x: ~x.startswith(prefix))
    return F.struct(kept.alias("kept"), (F.size(evidence) - F.size(kept)).alias("dropped"))


def question_rows(records: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """(key, number, question): the questions of records (key, questions array<string>) whose document there is."""
    return records.join(documents.select(key), key, "left_semi").select(key, F.posexplode("questions").alias("number", "question"))


def evidence_spans(evidences: Column, rendering: str) -> Column:
    """Spans (doc_id, start, end) of an item's evidence in a rendering: empty without evidence, null if it has some but
    none in this rendering.  Evidence has doc_id, start and end, and a struct (start, end) for each other rendering."""
    at = (lambda e: e) if rendering == "txt" else (lambda e: e[rendering])
    there = F.filter(evidences, lambda e: at(e)["start"].isNotNull())
    spans = F.transform(there, lambda e: F.struct(e["doc_id"].alias("doc_id"), at(e)["start"].alias("start"), at(e)["end"].alias("end")))
    return F.when((F.size(evidences) == 0) | (F.size(there) > 0), spans)


def item_documents(evidences: Column, doc_ids: Column, doc_id: Column) -> Column:
    """An item's documents, sorted: its evidence's, else those it names, else the one it names."""
    own = F.array_sort(F.array_distinct(F.transform(evidences, lambda e: e["doc_id"])))
    named = F.array_sort(F.array_distinct(F.coalesce(doc_ids, F.array().cast("array<bigint>"))))
    one = F.when(doc_id.isNotNull(), F.array(doc_id)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).otherwise(one)


def weak_groups(rows: DataFrame, key: str, good: Column) -> DataFrame:
    """(key, n, good, weak): groups in which fewer than half of the rows are good are weak."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    return out.withColumn("weak", F.col("good") * 2 < F.col("n"))
