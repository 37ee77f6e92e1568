"""Planned runs as tables: chunks, indexes, rankings and summaries, each continued where it was stopped.

A stage writes its rows in parts and then one row into ``commits``; only parts that stand there are read, so what a lost
driver left half written never counts, and the next call does the rest.  The work left is an anti-join of ids.
"""

from __future__ import annotations

import inspect
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import providers
from ..functions import text as T
from ..operators import augmentation as A
from ..operators import evaluation as E
from ..operators import reports
from ..operators import retrieval as R
from ..session import kept
from ..sources import files
from . import runs

ID = ["doc_id", "chunk_index"]


@dataclass
class Dataset:
    """``renderings``: (doc_id, text) by name.  ``items``: item_id, question, answer, answerable, docs array<long>, n_evidence
    and ``spans``, a map from renderings to arrays of (doc_id, start, end)."""

    renderings: dict[str, DataFrame]
    items: DataFrame


class Parts:
    """The tables of one stage under a folder, written part by part."""

    def __init__(self, spark: SparkSession, path: str, config: dict):
        self.spark, self.path = spark, path
        files.start_run(spark, path, config)

    def commits(self) -> list[Row]:
        """(part, stage, n, seconds), one for each part that counts."""
        try:
            return self.spark.read.parquet(f"{self.path}/commits").orderBy("at", "part").collect()
        except AnalysisException:
            return []

    def read(self, table: str, stage: str) -> DataFrame | None:
        """A table's committed rows; None before there are any."""
        paths = [f"{self.path}/{table}/part={r.part}" for r in self.commits() if r.stage == stage]
        return self.spark.read.parquet(*paths) if paths else None

    def left(self, rows: DataFrame, table: str, stage: str, keys: list[str]) -> DataFrame:
        """Rows whose keys a table has not."""
        done = self.read(table, stage)
        return rows if done is None else rows.join(done.select(*keys), keys, "left_anti")

    def add(self, stage: str, **tables: DataFrame | Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        """One part: tables in turn, a callable made from those that are written already; then its commit, with the number
        of rows in the last table."""
        part, began, made = uuid.uuid4().hex, time.time(), {}
        for name, rows in tables.items():
            path = f"{self.path}/{name}/part={part}"
            (rows(made) if callable(rows) else rows).write.parquet(path)
            made[name] = self.spark.read.parquet(path)
        n = made[list(tables)[-1]].count()
        row = (part, stage, n, round(time.time() - began, 3), time.time())
        self.spark.createDataFrame([row], "part string, stage string, n long, seconds double, at double").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def _chunked(docs: DataFrame, run: dict) -> DataFrame:
    chunker, params = runs.CHUNKERS[run["method"]], dict(run["params"])
    if model := params.pop("embedding_model", None):
        params["embed"] = runs.EMBEDDERS[model]
    chunks = chunker(docs, **params)
    if "chunk_text" in chunks.columns:
        return chunks
    # sections come as places; those of HTML are read without their tags
    part = T.cut(F.col("text"), F.col("start"), F.col("end"))
    plain = T.plain_html(part) if run["rendering"] == "html" else part
    return chunks.join(docs.select("doc_id", "text"), "doc_id").withColumn("chunk_text", plain).drop("text")


def _augmented(chunks: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        f = runs.AUGMENTERS[name]
        chunks = f(chunks, docs) if "docs" in inspect.signature(f).parameters else f(chunks)
    return A.updated(chunks)


def _counted(docs: DataFrame) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """(doc_id, characters, chunks) of the documents of a part, also of those without chunks."""

    def rows(made: dict[str, DataFrame]) -> DataFrame:
        counts = list(made.values())[-1].groupBy("doc_id").agg(F.count("*").alias("n"))
        sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("characters"))
        return sizes.join(counts, "doc_id", "left").select("doc_id", "characters", F.coalesce("n", F.lit(0)).alias("chunks"))

    return rows


class Run:
    """One run of :func:`runs.plan` over a dataset, its tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, run: dict, data: Dataset):
        self.spark, self.root, self.run, self.data = spark, root, run, data

    def _parts(self, kind: str, config: dict, *more: str) -> Parts:
        return Parts(self.spark, "/".join([self.root, kind, self.run["directory"], *more]), config)

    # --- chunks

    def chunk(self, waves: int = 1) -> None:
        """Chunks, and augments, the documents that are not finished.  Each of ``waves`` reads the corpus again and is
        committed by itself: more of them lose less when the driver is lost.

        The two stages are written one after the other, so that each has its own cost; a part's documents are committed
        with its chunks."""
        parts, docs = self._chunk_parts(), self.data.renderings[self.run["rendering"]].where("doc_id is not null")
        todo = parts.left(docs, "documents", "chunking", ["doc_id"])
        for wave in range(waves):
            some = todo.where(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == wave)
            if not some.isEmpty():
                parts.add("chunking", chunks=_chunked(some, self.run), documents=_counted(some))
        if self.run["augmentations"]:
            plain = parts.read("chunks", "chunking")
            done = parts.read("augmented_documents", "augmentation")
            ids = parts.read("documents", "chunking").select("doc_id", "characters")
            ids = ids if done is None else ids.join(done, "doc_id", "left_anti")
            if not ids.isEmpty():
                some, texts = plain.join(ids, "doc_id", "left_semi"), docs.join(ids, "doc_id", "left_semi")
                parts.add("augmentation", augmented=_augmented(some, texts, self.run["augmentations"]), augmented_documents=ids.select("doc_id"))

    def _chunk_parts(self) -> Parts:
        return self._parts("chunks", runs.fingerprint(self.run))

    def chunks(self) -> DataFrame:
        """The run's chunks; its :meth:`chunk` comes first."""
        table, stage = ("augmented", "augmentation") if self.run["augmentations"] else ("chunks", "chunking")
        return self._there(self._chunk_parts().read(table, stage), "chunks")

    def documents(self) -> DataFrame:
        return self._there(self._chunk_parts().read("documents", "chunking"), "chunks")

    def _there(self, rows: DataFrame | None, what: str) -> DataFrame:
        if rows is None:
            raise FileNotFoundError(f"{self.run['directory']} has no {what} yet")
        return rows

    def costs(self) -> DataFrame:
        """(stage, documents, seconds) over all parts."""
        rows = [(r.stage, r.n, r.seconds) for r in self._chunk_parts().commits()]
        made = self.spark.createDataFrame(rows, "stage string, n long, seconds double")
        return made.groupBy("stage").agg(F.sum("n").alias("documents"), F.round(F.sum("seconds"), 3).alias("seconds"))

    # --- index

    def _index_parts(self, model: str) -> Parts:
        return self._parts("indexes", {"chunks": self.run["directory"], "embedding": model}, model)

    @staticmethod
    def _embedded_text(chunks: DataFrame) -> Column:
        return A.embedded_text(F.col("text_to_embed"), F.col("chunk_text")) if "text_to_embed" in chunks.columns else F.col("chunk_text")

    def index(self, model: str) -> None:
        """Vectors of the chunks that have none yet, and the postings anew if the chunks are not those they hold."""
        chunks, parts = self.chunks(), self._index_parts(model)
        chunks = chunks.select(*ID, self._embedded_text(chunks).alias("chunk_text"))
        todo = parts.left(chunks, "vectors", "embedding", ID)
        if not todo.isEmpty():
            parts.add("embedding", vectors=R.embedded(todo, ID, "chunk_text", runs.EMBEDDERS[model]))
        try:
            R.open_index(self.spark, f"{parts.path}/sparse", chunks.count())
        except (AnalysisException, ValueError):
            R.write_index(chunks, f"{parts.path}/sparse")

    def stores(self, model: str) -> tuple[DataFrame, R.SparseIndex]:
        """Vectors and postings; refused unless both hold every chunk."""
        parts, n = self._index_parts(model), self.chunks().count()
        vectors = self._there(parts.read("vectors", "embedding"), "vectors")
        if (have := vectors.count()) != n:
            raise ValueError(f"{parts.path} holds {have} vectors, not {n}")
        return vectors, R.open_index(self.spark, f"{parts.path}/sparse", n)

    # --- items

    def items(self) -> tuple[DataFrame, DataFrame]:
        """The items that can be scored, with the spans of the run's rendering, and (reason, count) of those left out."""
        spans = F.coalesce(F.col("spans")[self.run["rendering"]], F.array().cast("array<struct<doc_id:bigint,start:int,end:int>>"))
        rows = self.data.items.withColumn("spans", spans).withColumn("n_spans", F.size("spans"))
        indexed = self.documents().where("chunks > 0").select(F.col("doc_id").alias("d"), F.lit(True).alias("there"))
        named = rows.select("item_id", F.explode("docs").alias("d")).join(indexed, "d", "left")
        have = named.groupBy("item_id").agg(F.array_agg(F.when(F.col("there"), F.col("d"))).alias("indexed"))
        rows = rows.join(have, "item_id", "left").withColumn("indexed", F.coalesce("indexed", F.array().cast("array<bigint>")))
        rows = rows.join(E.eligibility(rows), "item_id")
        return rows.where("reason = 'keep'").drop("indexed", "n_spans", "reason"), rows.where("reason <> 'keep'").groupBy("reason").count()

    # --- rankings

    def _ranking_parts(self, model: str, option: dict, rerank: dict | None = None) -> Parts:
        config = {"index": [self.run["directory"], model], "retrieval": option, "reranking": rerank, "chunks": runs.fingerprint(self.run)}
        return self._parts("results", config, model, option["name"], *([rerank["name"]] if rerank else []))

    def retrieve(self, model: str, option: dict, max_items: int | None = None) -> None:
        """Rankings of the items that have none; of the first ``max_items`` of the sample order if that is given."""
        items, _ = self.items()
        items = items if max_items is None else E.sampled(items, max_items)
        parts = self._ranking_parts(model, option)
        todo = kept(parts.left(items.select("item_id", "question"), "questions", "retrieval", ["item_id"]))
        if not todo.isEmpty():
            vectors, sparse = self.stores(model)
            queries = todo.select("item_id", F.col("question").alias("query"))
            asked = R.embedded(queries, ["item_id"], "query", runs.EMBEDDERS[model])
            near = R.nearest(vectors, asked, option["top_k"]) if option["method"] != "sparse" else None
            found = R.retrieve(option["method"], sparse, queries, option["top_k"], near)
            places = self.chunks().select(*ID, "start", "end")
            parts.add("retrieval", ranking=found.join(places, ID), questions=todo)
        todo.unpersist()

    def rerank(self, model: str, option: dict, rerank: dict, max_items: int | None = None) -> None:
        """Reranks the retrieved chunks of the items that are not reranked yet, by their texts to embed."""
        before, parts = self._ranking_parts(model, option), self._ranking_parts(model, option, rerank)
        asked = self._there(before.read("questions", "retrieval"), "rankings")
        asked = asked if max_items is None else E.sampled(asked, max_items)
        todo = kept(parts.left(asked, "questions", "retrieval", ["item_id"]))
        if not todo.isEmpty():
            ranking = before.read("ranking", "retrieval").join(todo.select("item_id"), "item_id", "left_semi")
            chunks = self.chunks()
            texts = chunks.select(*ID, self._embedded_text(chunks).alias("chunk_text"))
            queries = todo.select("item_id", F.col("question").alias("query"))
            found = R.reranked(ranking, texts, queries, rerank["top_k"], runs.RERANKERS[rerank["model"]])
            parts.add("retrieval", ranking=found.join(chunks.select(*ID, "start", "end"), ID), questions=todo)
        todo.unpersist()

    # --- scores

    def evaluate(self, model: str, option: dict, rerank: dict | None = None, max_items: int | None = None, judge: str | None = None, k: int = 5, judged: int = 200) -> Row:
        """Scores a ranking against the evidence and, with a ``judge``, by its verdicts; the summary is written and returned.
        Verdicts of other judges that an earlier summary has stay in it."""
        parts = self._ranking_parts(model, option, rerank)
        asked = self._there(parts.read("questions", "retrieval"), "rankings").select("item_id")
        items, skipped = self.items()
        items = items.join(asked, "item_id", "left_semi")
        items = kept(items if max_items is None else E.sampled(items, max_items))
        ranking = parts.read("ranking", "retrieval").join(items.select("item_id"), "item_id", "left_semi")
        evidence = items.select("item_id", F.explode("spans").alias("s")).select("item_id", "s.*")
        gold = items.select("item_id", F.explode("docs").alias("doc_id"))
        chunks = self.chunks().select(*ID, "start", "end")
        metrics = E.per_question(ranking, evidence, items, chunks, gold=gold)
        settings = {"run": parts.path.removeprefix(f"{self.root}/results/"), "dataset": self.run["dataset"], "embedding": model, "retrieval": option["name"], "reranking": rerank["name"] if rerank else "none"}
        row = reports.run_summary(metrics, settings, chunks, skipped).first()
        path = f"{parts.path}/evaluation/summary"
        try:
            verdicts = dict(self.spark.read.schema("ragas map<string,struct<context_precision:double,context_recall:double,items:long,failed:long>>").json(path).first()["ragas"] or {})
        except AnalysisException:
            verdicts = {}
        if judge:
            verdicts[f"{judge}-k={k}"] = self._judged(parts, items, ranking, judge, k, judged)
        cost = {c.stage: c.seconds for c in self.costs().collect()} | {"retrieval_seconds": sum(c.seconds for c in parts.commits() if c.stage == "retrieval")}
        out = Row(**(row.asDict(recursive=True) if row else settings), cost=cost, ragas={n: tuple(v) for n, v in verdicts.items()})
        kinds = {"run": "string", "dataset": "string", "embedding": "string", "retrieval": "string", "reranking": "string", "chunks": "long", "documents": "long", "mean_chunk_chars": "double", "items": "map<string,long>", "skipped": "map<string,long>", "metrics": "map<string,map<string,double>>", "cost": "map<string,double>", "ragas": "map<string,struct<context_precision:double,context_recall:double,items:long,failed:long>>"}
        schema = ", ".join(f"{n} {kinds[n]}" for n in out.__fields__)
        self.spark.createDataFrame([tuple(out)], schema).coalesce(1).write.mode("overwrite").json(path)
        items.unpersist()
        return out

    def _judged(self, parts: Parts, items: DataFrame, ranking: DataFrame, judge: str, k: int, judged: int) -> tuple:
        """Verdicts of the first ``judged`` items with an answer; those that failed are asked for again."""
        own = Parts(self.spark, f"{parts.path}/evaluation/{runs.run_name(judge, {'k': k})}", {"judge": judge, "k": k})
        sample = items.where("coalesce(answer, '') <> ''")
        sample = kept(E.sampled(sample, judged).select("item_id", "question", "answer"))
        before = own.read("verdicts", "judge")
        stands = None if before is None else files.without_failures(before).select("item_id")
        todo = sample if stands is None else sample.join(stands, "item_id", "left_anti")
        if not todo.isEmpty():
            chunks = self.chunks()
            known = {n: F.array_join(n, "\n") if n == "questions" else F.col(n) for n in A.ORDER if n in chunks.columns}
            shown = ranking.where(F.col("rank") <= k).join(chunks.select(*ID, A.text_for_llm(F.col("chunk_text"), known).alias("shown")), ID)
            contexts = shown.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]).alias("contexts"))
            rows = todo.join(contexts, "item_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
            made = rows.select("item_id", JUDGES[judge](F.col("question"), F.col("answer"), F.col("contexts")).alias("v")).select("item_id", "v.*")
            own.add("judge", verdicts=made)
        every = own.read("verdicts", "judge")
        if every is None:
            return None, None, 0, 0
        # a verdict that stands goes before failures of the same item
        best = every.join(sample.select("item_id"), "item_id", "left_semi").groupBy("item_id")
        best = best.agg(F.min_by(F.struct("context_precision", "context_recall", "error"), F.col("error").isNotNull()).alias("v")).select("v.*")
        r = E.judge_summary(best).first()
        sample.unpersist()
        return r["context_precision"], r["context_recall"], r["items"], r["failed"]


#: Judges by name: columns of question, answer and contexts to a struct (context_precision, context_recall, error).
JUDGES: dict[str, Callable[[Column, Column, Column], Column]] = {"overlap_judge": providers.overlap_judge}


def execute(spark: SparkSession, root: str, config: dict, data: dict[str, Dataset], max_items: int | None = None, judge: str | None = None, keep_going: bool = False) -> list[Row]:
    """Every run of a config from documents to summaries; a second call does what is left."""
    out: list[Row] = []

    def one(planned: dict) -> None:
        run = Run(spark, root, planned, data[planned["dataset"]])
        run.chunk()
        for model in planned["embeddings"]:
            run.index(model)
            for option in planned["retrieval"]:
                run.retrieve(model, option, max_items)
                out.append(run.evaluate(model, option, None, max_items, judge))
                for rerank in planned["reranking"]:
                    run.rerank(model, option, rerank, max_items)
                    out.append(run.evaluate(model, option, rerank, max_items, judge))

    runs.run_each(runs.plan(config, renderings=lambda d: data[d].renderings), one, keep_going=keep_going)
    return out
