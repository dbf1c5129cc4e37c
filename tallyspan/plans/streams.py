"""Streams over the events table, run to their end; batch SQL is their oracle.

Results go to tables in the shared folder; the driver holds no rows of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.plans import relational
from tallyspan.session import shared_dir
from tallyspan.streaming import stateful


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("usr"), F.col("event_type").alias("kind"))


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """The result of a stream that ran to its end: all batches of an append stream, the last one of a complete stream."""
    spark, at = df.sparkSession, f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    written: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is tried again overwrites what it left.
        batch.write.mode("overwrite").parquet(path := f"{at}/rows/{number}")
        written[:] = [path] if mode == "complete" else [*(p for p in written if p != path), path]

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(*written) if written else spark.createDataFrame([], df.schema)


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(stateful.tumbling(_events(spark, sf), "ts", "1 hour", "1 day", ["kind"]), "complete")
    return out.select(F.unix_micros("window.start").alias("start_us"), "kind", "n")


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(stateful.sliding(_events(spark, sf), "ts", "1 hour", "15 minutes", "1 day", []), "complete")
    return out.select(F.unix_micros("window.start").alias("start_us"), "n")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = _drained(stateful.sessions(_events(spark, sf), "ts", "4 hours", "1 day", ["usr"]), "complete")
    return out.select("usr", F.unix_micros("session_window.start").alias("start_us"), "n")


def stream_slots(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("id", "usr", F.unix_micros("ts").alias("us"))
    return _drained(stateful.slot_stream(e, "usr", "us", "id", 3_600_000_000), "append").select("id", "slot")


QUERIES = {"stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_slots": stream_slots}
ORACLE = {"stream_tumbling": relational.ORACLE["tumbling"], "stream_sliding": relational.ORACLE["sliding"], "stream_sessions": relational.ORACLE["session_counts"], "stream_slots": relational.ORACLE["slot_reservation"]}
