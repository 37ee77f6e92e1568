"""A session with the settings that the library's plans assume."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "spanloom", **settings: str) -> SparkSession:
    """Session with adaptive execution, last-wins map merging and UTC; ``settings`` use ``_`` for ``.``-free overrides."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder that ``spark.checkpoint.dir`` names: for iterations.  Only on a
    local master may that be unset."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` cached where its rows are, as several branches of a plan read it; lost parts are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
