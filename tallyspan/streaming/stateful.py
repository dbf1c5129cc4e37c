"""Stateful streams over events: limiters, claims, breakers, retries and event-time windows.

Every stream takes a streaming (or batch) DataFrame whose time column is a timestamp with a zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspan.operators.limits import Bucket, take


def _frames(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    got = list(batches)
    return pd.concat(got) if got else pd.DataFrame()


def slot_stream(events: DataFrame, key: str, at: str, tie: str, interval: int) -> DataFrame:
    """(key, tie, slot): slots as in `limits.reserve_slots`, with the next free slot of each key as state."""
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = _frames(batches).sort_values([at, tie])
        free, slots = state.get[0] if state.exists else None, []
        for t in b[at]:
            s = int(t) if free is None else max(int(t), free)
            slots.append(s)
            free = s + interval
        state.update((free,))
        yield pd.DataFrame({key: k[0], tie: b[tie].to_numpy(), "slot": slots})

    schema = f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, slot long"
    return events.select(key, at, tie).groupBy(key).applyInPandasWithState(run, schema, "free long", "append", GroupStateTimeout.NoTimeout)


def bucket_stream(events: DataFrame, key: str, at: str, tie: str, limits: list[tuple[float, float]]) -> DataFrame:
    """(key, tie, allowed): token buckets as in `limits.token_bucket`, with tokens and time as state."""
    kinds = dict(events.dtypes)
    n = len(limits)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = _frames(batches).sort_values([at, tie])
        held = state.get if state.exists else (None,) * (n + 1)
        buckets = [Bucket(c, r, tokens=held[i], at=held[n]) for i, (c, r) in enumerate(limits)]
        allowed = [take(buckets, float(t)) for t in b[at]]
        state.update((*(x.tokens for x in buckets), buckets[0].at))
        yield pd.DataFrame({key: k[0], tie: b[tie].to_numpy(), "allowed": allowed})

    held = ", ".join([*(f"t{i} double" for i in range(n)), "at double"])
    return events.select(key, F.col(at).cast("double").alias(at), tie).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, allowed boolean", held, "append", GroupStateTimeout.NoTimeout)


def claim_once(events: DataFrame, key: list[str], at: str, ttl: str) -> DataFrame:
    """The first event of each key; repeats within ``ttl`` are dropped, and state older than that is freed."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(key)


def breaker_stream(events: DataFrame, source: str, at: str, blocked: Column) -> DataFrame:
    """(source, opened_at): the first detection opens a source's breaker for good; later ones change nothing."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = min(b["_at"].min() for b in batches)
        if not state.exists:
            state.update((first.to_pydatetime(),))
            yield pd.DataFrame({source: [k[0]], "opened_at": [first]})

    found = events.where(blocked).select(source, F.col(at).alias("_at"))
    return found.groupBy(source).applyInPandasWithState(run, f"`{source}` {dict(events.dtypes)[source]}, opened_at timestamp", "opened_at timestamp", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, by: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, gap: str, late: str, by: list[str]) -> DataFrame:
    return events.withWatermark(at, late).groupBy(*by, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def with_retries(batch: DataFrame, ok: Column, retry: Column, reason: Column, attempts: str = "attempt", most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, again, dead) of a batch of jobs: failures that may be retried come again with one attempt more, the rest
    go to the dead letters with a reason."""
    done = batch.where(ok)
    failed = batch.where(~F.coalesce(ok, F.lit(False)))
    may = F.coalesce(retry, F.lit(False)) & (F.col(attempts) + 1 < most)
    again = failed.where(may).withColumn(attempts, F.col(attempts) + 1)
    dead = failed.where(~may).withColumn("reason", F.when(F.coalesce(retry, F.lit(False)), "retries exhausted").otherwise(reason))
    return done, again, dead


class DeadLetters:
    """Dead letters as a parquet table: list, inspect, replay and purge."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, dead: DataFrame) -> None:
        dead.withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        return self.spark.read.parquet(self.path).orderBy(F.coalesce("failed_at", F.lit("1970-01-01").cast("timestamp")))

    def take(self, condition: Column) -> DataFrame:
        """Letters to run again, with no attempts counted."""
        return self.list().where(condition).drop("failed_at", "reason").withColumn("attempt", F.lit(0))

    def purge(self, condition: Column) -> str:
        """Writes the letters that stay to a new folder and points to it."""
        new = f"{self.path}-kept"
        self.list().where(~F.coalesce(condition, F.lit(False))).write.mode("overwrite").parquet(new)
        self.path = new
        return new


def watch_fingerprint(columns: list[Column], on_change) -> object:
    """A foreachBatch function that calls ``on_change(old, new)`` when the content of a batch's table changes."""
    from tallyspan.operators.aggregate import fingerprint

    seen: dict[str, str | None] = {"last": None}

    def run(batch: DataFrame, _: int) -> None:
        now = fingerprint(batch, columns).first().fingerprint
        if seen["last"] is not None and now != seen["last"]:
            on_change(seen["last"], now)
        seen["last"] = now

    return run
