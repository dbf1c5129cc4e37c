"""Rate limits in batch: slot reservation in closed form, token buckets as a fold over each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reserve_slots(df: DataFrame, key: str, at: str, tie: str, interval: int, name: str = "slot") -> DataFrame:
    """Each request's slot: not before its time nor within ``interval`` of the slot before, in order of arrival.

    ``at`` is a long. slot_n = n * I + max over i <= n of (t_i - i * I), which needs no fold.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    n = F.row_number().over(w) - 1
    base = df.withColumn("_n", n.cast("long"))
    best = F.max(F.col(at) - F.col("_n") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return base.withColumn(name, F.col("_n") * interval + best).drop("_n")


class Bucket:
    """State of a token bucket; a refusal takes nothing."""

    def __init__(self, capacity: float, per_second: float, tokens: float | None = None, at: float | None = None):
        self.capacity, self.rate = capacity, per_second
        self.tokens, self.at = capacity if tokens is None else tokens, at

    def refill(self, now: float) -> None:
        if self.at is not None and now > self.at:
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now if self.at is None else max(self.at, now)


def take(buckets: list[Bucket], now: float) -> bool:
    """One token from every bucket, or from none."""
    for b in buckets:
        b.refill(now)
    if any(b.tokens < 1 for b in buckets):
        return False
    for b in buckets:
        b.tokens -= 1
    return True


def penalise(next_slot: int, now: int, backoff: int) -> int:
    """Next slot after a server asked for a pause: at least ``backoff`` from now, never earlier than it was."""
    return max(next_slot, now + backoff)


def token_bucket(df: DataFrame, key: str, at: str, tie: str, limits: list[tuple[float, float]]) -> DataFrame:
    """(key, tie, allowed): requests passed through buckets of (capacity, tokens per second), all or nothing.

    There is no closed form, as refusals don't charge; keys are folded one by one over sorted partitions, row by
    row, so a frequent key streams through its task rather than being held.
    """
    kinds = dict(df.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), []
        for b in batches:
            out = []
            for k, t in zip(b[key], b["_s"], strict=True):
                if k != current:
                    current, state = k, [Bucket(c, r) for c, r in limits]
                out.append(take(state, t))
            yield pd.DataFrame({key: b[key], tie: b[tie], "allowed": out})

    ordered = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, tie, F.col(at).cast("double").alias("_s")).repartition(key).sortWithinPartitions(key, "_s", tie)
    return ordered.mapInPandas(fold, f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, allowed boolean")
