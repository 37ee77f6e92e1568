"""Sources and sinks: document folders, JSON lines, Parquet, TSV, zip and tar archives, run folders; resumable writes."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folder and extension of a document's renderings.
RENDERINGS = {"txt": ("txt", "*.txt"), "md": ("md", "*.md"), "html": ("html", "*.html")}
ITEM = "id string, question string, answer string, evidences array<struct<doc_id:string,text:string,start:int,end:int,match:string,kind:string>>, metadata string"


def read_documents(spark: SparkSession, path: str, rendering: str = "txt", limit: int | None = None) -> DataFrame:
    """(doc_id, text) of a rendering's files; ``limit`` takes the first by name.  A rendering that has none is an error."""
    folder, glob = RENDERINGS[rendering]
    rows = spark.read.option("pathGlobFilter", glob).text(f"{path}/{folder}", wholetext=True)
    name = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))
    return rows.orderBy("doc_id").limit(limit) if limit is not None else rows


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_items(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Question items of several files, as one table."""
    return spark.read.schema(ITEM).json(list(paths))


def read_tsv(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> DataFrame:
    """A tab-separated table with a header, the rows whose ``column`` is among ``values``."""
    return spark.read.csv(path, sep="\t", header=True).where(F.col(column).isin(*values))


def snake_case(df: DataFrame) -> DataFrame:
    """Column names lower-cased, spaces as underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text): files of zip and tar archives, decoded as UTF-8 with replacement characters."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for name, data in zip(f["path"], f["content"]):
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out += [(name, m.filename, z.read(m).decode("utf-8", "replace")) for m in z.infolist() if not m.is_dir()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        out += [(name, m.name, t.extractfile(m).read().decode("utf-8", "replace")) for m in t if m.isfile()]
            yield pd.DataFrame(out, columns=["archive", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, text string")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """All ``evaluation/summary.json`` files under a folder."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").option("multiLine", True).json(path)


def canonical(config: dict) -> str:
    """A config as JSON that compares equal whatever the order of keys and tuples for lists."""
    return json.dumps(config, sort_keys=True, ensure_ascii=False)


def start_run(spark: SparkSession, path: str, config: dict) -> bool:
    """Marks a folder with its config; True if it is new, False if it had the same, an error if it had another."""
    try:
        old = spark.read.text(f"{path}/config.json", wholetext=True).first()[0].strip()
    except (AnalysisException, Py4JJavaError):
        spark.createDataFrame([(canonical(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config.json")
        return True
    if old != canonical(config):
        raise ValueError(f"{path} was started with another config")
    return False


def append_missing(new: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose keys a Parquet table has not yet (a resumable, idempotent write); how many came."""
    spark = new.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except AnalysisException:
        done = new.select(*keys).limit(0)
    todo = new.join(done, list(keys), "left_anti").persist()
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    todo.unpersist()
    return n


def committed(chunks: DataFrame, finished: DataFrame) -> DataFrame:
    """Chunks of finished documents (doc_id, chunks); an error if a document has fewer than it committed."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("have"))
    short = finished.join(counts, "doc_id", "left").where(F.coalesce("have", F.lit(0)) < F.col("chunks"))
    if lost := short.limit(3).collect():
        raise ValueError(f"committed chunks are missing: {[r.doc_id for r in lost]}")
    return chunks.join(finished.select("doc_id"), "doc_id", "left_semi")


def without_failures(verdicts: DataFrame) -> DataFrame:
    """Verdicts that stand; the failed ones are to be judged again."""
    return verdicts.where("error is null")


def export_chunks(chunks: DataFrame, path: str, kind: str = "json", tokens=T.n_words) -> None:
    """Chunks with their length and number of tokens as JSON lines or as CSV with a header, written whole over what was
    there; line ends and quotes inside a text stay."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = chunks.select("doc_id", "chunk_index", "start", "end", F.length("chunk_text").alias("length"), tokens(F.col("chunk_text")).alias("tokens"), F.col("chunk_text").alias("text"))
    out = rows.write.mode("overwrite")
    out.json(path) if kind == "json" else out.csv(path, header=True, escape='"', quoteAll=True)
