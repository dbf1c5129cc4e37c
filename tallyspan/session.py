"""Sessions, shared storage and partition sizing."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Arrow task may hold at once; buckets are sized from it.
ROWS_PER_BUCKET = 200_000


def get_session(app: str = "tallyspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``conf`` overrides (underscores stand for dots)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session, else a local one.

    The local folder is only for sessions of one machine, where the setting is unset.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = os.path.join(tempfile.gettempdir(), f"tallyspan-{os.getpid()}")
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows written as parquet in the shared folder and read again; the shuffle files of the write are deleted."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, rows: int, per: int = ROWS_PER_BUCKET) -> int:
    """Number of hash buckets so that one holds about ``per`` rows and every core gets some."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism, math.ceil(rows / per))
