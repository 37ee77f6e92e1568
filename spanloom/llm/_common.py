"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r.  Fixed by the contracts.
SPACE = "\x20\x09-\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of the session's ``spark.checkpoint.dir``.  Where that is unset, a local master (tests)
    gets a new folder of its own; on a cluster it is an error, as executors do not share a machine's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints and read again: as :func:`checkpointed`, for wide
    rows of which later steps read some columns.  The folder stays until the shared folder is cleared."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Copies of a row that one task makes at a time.
COPIES = 4096


def numbered_copies(rows: DataFrame, copies: str, number: str, keys: list[str]) -> DataFrame:
    """``rows`` as often as the column ``copies`` says, numbered from 0; the copies of a row, one of ``keys``, are dealt
    over tasks in parts of ``COPIES``."""
    head = "_" + number
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES).cast("long"))).alias(head))
    upto = F.least(F.col(copies), F.col(head) + COPIES) - 1
    return parts.repartition(*keys, head).select("*", F.explode(F.sequence(F.col(head), upto)).alias(number)).drop(head)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until it differs from every taken column name (Spark ignores case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def in_arrow(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from dicts of Arrow columns to dicts of columns named as in ``schema``."""
    names = [x.split()[0] for x in schema.split(",")]
    spark = df.sparkSession
    types = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(types)
        for columns in f({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([_array(columns[n], out.field(n).type) for n in names], schema=out)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def binary(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def uniform(*columns, seed: int = 0):
    """A column of 60-bit non-negative integers, uniform and the same in every run: the head of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
