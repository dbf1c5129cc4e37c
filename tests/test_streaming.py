from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import limits
from tallyspan.streaming import stateful

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    """A stream with one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_limiters_match_batch(spark, tmp_path):
    schema = "k string, t long, id long"
    rows = [("a" if i % 3 else "b", i * 4 + (i % 5), i) for i in range(24)]
    s = stream(spark, tmp_path, [rows[:9], rows[9:15], rows[15:]], schema)
    batch = spark.createDataFrame(rows, schema)
    got = {(r.id, r.slot) for r in run(stateful.slot_stream(s, "k", "t", "id", 11), "slots", tmp_path).collect()}
    assert got == {(r.id, r.slot) for r in limits.reserve_slots(batch, "k", "t", "id", 11).collect()}
    lim = [(2.0, 0.05), (3.0, 0.2)]
    got = {(r.id, r.allowed) for r in run(stateful.bucket_stream(s, "k", "t", "id", lim), "bucket", tmp_path).collect()}
    assert got == {(r.id, r.allowed) for r in limits.token_bucket(batch, "k", "t", "id", lim).collect()}


def test_claims_breaker_windows(spark, tmp_path):
    schema = "k string, ts timestamp, bad boolean"
    at = lambda m: T0 + timedelta(minutes=m)
    s = stream(spark, tmp_path, [[("a", at(0), False), ("a", at(1), True), ("b", at(2), False)], [("a", at(3), True), ("b", at(40), True)], [("b", at(60), False)]], schema)
    assert run(stateful.claim_once(s, ["k"], "ts", "10 minutes"), "claims", tmp_path).count() == 2
    opened = {r.k: r.opened_at for r in run(stateful.breaker_stream(s, "k", "ts", F.col("bad")), "breaker", tmp_path).collect()}
    assert opened == {"a": at(1), "b": at(40)}
    n = {r.window.start: r.n for r in run(stateful.tumbling(s, "ts", "10 minutes", "5 minutes", []), "tumble", tmp_path, "complete").collect()}
    assert n == {at(0): 4, at(40): 1, at(60): 1}
    assert run(stateful.sessions(s, "ts", "5 minutes", "5 minutes", ["k"]), "sessions", tmp_path, "complete").count() == 4


def test_dead_letters(spark, tmp_path):
    b = spark.createDataFrame([(1, 0, True, None), (2, 0, False, True), (3, 2, False, True), (4, 0, None, False)], "id long, attempt int, ok boolean, again boolean")
    done, again, dead = stateful.with_retries(b, F.col("ok"), F.col("again"), F.lit("unreadable"))
    assert [r.id for r in done.collect()] == [1] and [(r.id, r.attempt) for r in again.collect()] == [(2, 1)]
    box = stateful.DeadLetters(spark, str(tmp_path / "dlq"))
    box.add(dead)
    assert {r.id: r.reason for r in box.list().collect()} == {3: "retries exhausted", 4: "unreadable"}
    assert [(r.id, r.attempt) for r in box.take(F.col("id") == 3).collect()] == [(3, 0)]
    box.purge(F.col("id") == 3)
    assert [r.id for r in box.list().collect()] == [4]


def test_watch(spark):
    seen = []
    f = stateful.watch_fingerprint([F.col("id")], lambda a, b: seen.append((a, b)))
    for n in (3, 3, 4):
        f(spark.range(n), 0)
    assert len(seen) == 1


def test_penalise():
    assert limits.penalise(5, 3, 10) == 13 and limits.penalise(50, 3, 10) == 50


@pytest.mark.parametrize("bad", [None])
def test_null_keys(spark, bad):
    d = spark.createDataFrame([(bad, 1, 1.0)], "k string, i long, t double")
    assert limits.token_bucket(d, "k", "t", "i", [(1, 1)]).count() == 0


def test_streams_leave_no_rows_on_the_driver(spark):
    """Results of streams are read from files, not from a table in the driver's memory."""
    from tallyspan.plans import streams

    for name, query in streams.QUERIES.items():
        out = query(spark, "/root/testdata/sf0.001")
        assert out.inputFiles() and not out.isEmpty(), name
