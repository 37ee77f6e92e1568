"""Chunk augmentation: derived text columns and the texts that are embedded or shown to a model."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import providers
from ..functions import text as T
from ..session import settled
from . import chunking

#: The known augmentations in the order in which they are shown.
ORDER = ("title", "doc_summary", "context", "keywords", "questions", "summary")


def text_to_embed(plain: Column, summary: Column, title: Column, doc_summary: Column, context: Column, keywords: Column, questions: Column) -> Column:
    """A summary replaces everything; else the filled parts joined by blank lines, the chunk's own text last."""
    asked = F.array_join(questions, "\n")
    parts = [F.nullif(x, F.lit("")) for x in (title, doc_summary, context, keywords, asked, plain)]
    return F.coalesce(F.nullif(summary, F.lit("")), F.concat_ws("\n\n", *parts))


def text_for_llm(original: Column, known: dict[str, Column]) -> Column:
    """Every filled augmentation under its name, then the text."""
    parts = [F.when(known[k] != "", F.concat(F.lit(f"{k}:\n"), known[k])) for k in ORDER if k in known]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("original_text:\n"), original))


def clean_keywords(answer: Column, n: int = 8) -> Column:
    items = F.transform(F.split(F.replace(answer, F.lit("\n"), F.lit(",")), ","), lambda x: F.trim(x))
    return F.array_join(F.slice(F.filter(items, lambda x: x != ""), 1, n), ", ")


#: Fixed value: what marks an item of a list.
LIST_MARK = r"^\s*(?:[-*•]|\d+[.)])\s*"


def clean_questions(answer: Column) -> Column:
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(x, LIST_MARK, "")))
    return F.filter(lines, lambda x: x != "")


def with_titles(chunks: DataFrame, k: int = 5, model=providers.first_sentence) -> DataFrame:
    """Adds ``title``: one model call a document over its first ``k`` chunks, joined back to all of them."""
    head = chunks.where(F.col("chunk_index") < k).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("h"))
    asked = head.select("doc_id", model(F.array_join(F.transform("h", lambda x: x["chunk_text"]), "\n\n")).alias("title"))
    return chunks.join(asked, "doc_id", "left")


def summarised(docs: DataFrame, most: int, model=providers.first_sentence, tokens=T.n_words, rounds: int = 20) -> DataFrame:
    """(doc_id, summary): texts are cut in equal pieces of at most ``most`` tokens, summed up piece by piece and joined,
    until one piece is left of each.

    Where a round leaves a text as it is, the model has nothing more to take out of it, and no further round would change
    it: the summaries of its pieces, joined, are its summary, whole.  So they are for texts that still change after
    ``rounds`` rounds."""
    now, done = docs.select("doc_id", "text"), None
    for i in range(rounds):
        pieces = now.select("doc_id", F.xxhash64("text").alias("was"), F.posexplode(chunking.equal_pieces(F.coalesce("text", F.lit("")), F.coalesce(tokens(F.col("text")), F.lit(0)), most)).alias("i", "piece"))
        pieces = pieces.select("doc_id", "was", F.struct("i", F.coalesce(model(F.col("piece")), F.lit("")).alias("s")).alias("p"))
        made = pieces.groupBy("doc_id", "was").agg(F.sort_array(F.collect_list("p")).alias("p"))
        made = made.select("doc_id", "was", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("text"))
        through = (F.col("n") == 1) | (F.xxhash64("text") == F.col("was")) | F.lit(i == rounds - 1)
        made = settled(made.select("doc_id", "text", through.alias("through")))
        # the other documents go round again
        out = made.where("through").select("doc_id", F.col("text").alias("summary"))
        done = out if done is None else done.unionByName(out)
        now = made.where("not through").select("doc_id", "text")
        if not now.limit(1).count():
            break
    return done


def with_context(chunks: DataFrame, docs: DataFrame, most: int = 8000, model=providers.first_sentence) -> DataFrame:
    """Adds ``context``: a note on the document around the chunk; long documents are shown as a window.

    A document meets its chunks once, as a list, and windows are sliced from its text in turn: no chunk carries the whole
    text along."""
    columns = chunks.columns
    names = [c for c in columns if c != "doc_id"]
    texts = docs.select("doc_id", "text", F.coalesce(T.n_words(F.col("text")), F.lit(0)).alias("words"))
    rows = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("own")).join(texts, "doc_id").select("doc_id", "own", "text", "words")

    def run(batches):
        for b in batches:
            at, every = b.column(1).offsets.to_pylist(), b.column(1).values
            cols = dict(zip(names, every.flatten()))
            starts, ends = (cols[c].to_numpy() for c in ("start", "end"))
            for r in range(b.num_rows):
                text, words, lo = b.column(2)[r].as_py(), b.column(3)[r].as_py(), at[r]
                n = len(text or "")
                width = int(n * most / words) if words > most else n
                shown: list[str | None] = []
                held = 0
                for j in range(lo, at[r + 1]):
                    first = max(0, min((int(starts[j]) + int(ends[j]) - width) // 2, n - width))
                    shown.append(None if text is None else text[first : min(n, first + width)])
                    held += width
                    if held >= chunking.HELD or j + 1 == at[r + 1]:
                        made = {k: c.slice(lo, j + 1 - lo) for k, c in cols.items()} | {"doc_id": pa.repeat(b.column(0)[r], j + 1 - lo)}
                        yield pa.RecordBatch.from_arrays([*(made[c] for c in columns), pa.array(shown, pa.string())], [*columns, "window"])
                        shown, held, lo = [], 0, j + 1

    schema = StructType([*chunks.schema.fields, StructField("window", StringType())])
    return rows.mapInArrow(run, schema).withColumn("context", model(F.col("window"))).drop("window")


def updated(chunks: DataFrame, **changes: Column) -> DataFrame:
    """Chunks with augmentations set and ``text_to_embed`` rebuilt, null where it is just the chunk."""
    rows = chunks.withColumns(changes)
    part = lambda c: F.col(c) if c in rows.columns else F.lit("")
    questions = F.col("questions") if "questions" in rows.columns else F.array().cast("array<string>")
    built = text_to_embed(F.col("chunk_text"), part("summary"), part("title"), part("doc_summary"), part("context"), part("keywords"), questions)
    return rows.withColumn("text_to_embed", F.nullif(built, F.col("chunk_text")))


def with_document_summaries(chunks: DataFrame, docs: DataFrame, most: int = 64_000, model=providers.first_sentence) -> DataFrame:
    """Adds ``doc_summary``, one for each document, to all of its chunks."""
    return chunks.join(summarised(docs, most, model).withColumnRenamed("summary", "doc_summary"), "doc_id", "left")


def with_keywords(chunks: DataFrame, count: int = 8, model=providers.frequent_terms) -> DataFrame:
    """Adds ``keywords``: a model's answer, cleaned, at most ``count`` of them."""
    return chunks.withColumn("keywords", clean_keywords(F.coalesce(model(F.col("chunk_text")), F.lit("")), count))


def with_questions(chunks: DataFrame, model=providers.first_sentence) -> DataFrame:
    """Adds ``questions``: a model's answer by lines, without list marks."""
    return chunks.withColumn("questions", clean_questions(F.coalesce(model(F.col("chunk_text")), F.lit(""))))


def with_summaries(chunks: DataFrame, model=providers.first_sentence) -> DataFrame:
    """Adds ``summary``, which replaces the chunk in the text to embed."""
    return chunks.withColumn("summary", model(F.col("chunk_text")))


def embedded_text(built: Column, original: Column) -> Column:
    """What is embedded: the built text, or the chunk's own where none was kept."""
    return F.coalesce(built, original)


def prompt(template: str, **parts: Column) -> Column:
    """A prompt template's text with each ``{name}`` filled from a column (null: nothing)."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(parts[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
