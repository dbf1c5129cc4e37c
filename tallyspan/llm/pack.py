"""Filling of containers of fixed capacity with items of varying length (problem 8).

Only the histogram of lengths (at most ``capacity`` bins) comes to the driver. Shallow combinations of lengths
that fill a window just below the capacity are enumerated, non-negative least squares gives how often each is
repeated so that together they use up the histogram, the counts are rounded down, and the rest is packed
greedily. Items then find their place by their rank among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Unused space that an enumerated combination may leave, and combinations tried for each first length.
WINDOW, PER_LENGTH = 2, 6
#: Ranks within a length are counted in so many parts, so that a frequent length isn't one task.
PARTS = 64


@dataclass
class Plan:
    """Runs of equal containers. Row i: ``length`` items of ranks from ``rank`` on, ``each`` to a container,
    from container ``first`` on, placed at ``at`` within it; ``count`` items in all."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    each: np.ndarray
    first: np.ndarray
    at: np.ndarray
    containers: int


def combinations(hist: np.ndarray, capacity: int, window: int = WINDOW, per_length: int = PER_LENGTH) -> list[list[tuple[int, int]]]:
    """Combinations [(length, copies)] of at most three lengths that leave at most ``window`` unused."""
    present = np.flatnonzero(hist)
    if not len(present):
        return []
    floor = np.zeros(capacity + 1, np.int64)  # the longest present length up to each size
    floor[present] = present
    np.maximum.accumulate(floor, out=floor)
    seen: dict[tuple, None] = {}
    for a in present[::-1].tolist():
        most = capacity // a
        for k in {1, most, max(1, most // 2)}:
            room = capacity - k * a
            if room == 0:
                seen[((a, k),)] = None
                continue
            b = present[present <= room]
            if not len(b):
                if room <= window:
                    seen[((a, k),)] = None
                continue
            for q in (np.ones(len(b), np.int64), room // b):
                rest = room - q * b
                c = floor[rest]
                waste = rest - c
                good = np.flatnonzero(waste <= window)
                if len(good) > per_length:
                    weight = hist[b[good]] / (1 + waste[good])
                    good = good[np.argsort(-weight, kind="stable")[:per_length]]
                for i in good.tolist():
                    parts: dict[int, int] = {}
                    for length, n in ((a, k), (int(b[i]), int(q[i])), (int(c[i]), 1)):
                        if length:
                            parts[length] = parts.get(length, 0) + n
                    seen[tuple(sorted(parts.items(), reverse=True))] = None
    return [list(p) for p in seen]


def repeats(hist: np.ndarray, combos: list[list[tuple[int, int]]], sweeps: int = 60) -> np.ndarray:
    """Non-negative x with least ||A x - hist||, by coordinate descent on the sparse columns of A."""
    rest = hist.astype(float)
    rows = [np.array([length for length, _ in c]) for c in combos]
    values = [np.array([n for _, n in c], float) for c in combos]
    norms = [float(v @ v) for v in values]
    x = np.zeros(len(combos))
    scale = max(1.0, float(hist.sum()))
    for _ in range(sweeps):
        moved = 0.0
        for i, (r, v, n) in enumerate(zip(rows, values, norms, strict=True)):
            new = max(0.0, x[i] + float(v @ rest[r]) / n)
            if new != x[i]:
                rest[r] -= v * (new - x[i])
                moved = max(moved, abs(new - x[i]))
                x[i] = new
        if moved < 1e-7 * scale:
            break
    return x


def plan(hist: np.ndarray, capacity: int) -> Plan:
    """Containers for ``hist[length]`` items of each length from 1 to ``capacity``."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    rows: list[tuple[int, int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, np.int64)
    total = 0

    def place(combo: list[tuple[int, int]], n: int) -> None:
        nonlocal total
        at = 0
        for length, each in combo:
            rows.append((length, used[length], n * each, each, total, at))
            used[length] += n * each
            left[length] -= n * each
            at += length * each
        total += n

    combos = combinations(left, capacity)
    x = repeats(left, combos) if combos else np.zeros(0)
    for i in np.argsort(-x, kind="stable").tolist():
        n = min(int(x[i] + 1e-9), *(int(left[length] // each) for length, each in combos[i]))
        if n > 0:
            place(combos[i], n)
    while left.any():
        present = np.flatnonzero(left)
        combo, room = [], capacity
        while room and (k := np.searchsorted(present, room, "right")):
            length = int(present[k - 1])
            each = int(min(left[length], room // length))
            combo.append((length, each))
            room -= each * length
            present = present[: k - 1]
        place(combo, max(1, min(int(left[length] // each) for length, each in combo)))
    cols = np.array(rows, np.int64).reshape(-1, 6)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return Plan(*(cols[:, i] for i in range(6)), containers=total)


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, begin, length): items no longer than ``capacity`` whole, longer ones cut into full pieces and a rest."""
    n = F.ceil(F.col(size) / F.lit(capacity)).cast("int")
    cut = sizes.where(F.col(size) > 0).select(key, F.col(size).alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    begin = F.col("piece").cast("long") * capacity
    return cut.select(key, "piece", begin.alias("begin"), F.least(F.lit(capacity).cast("long"), F.col("_n") - begin).alias("length"))


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048) -> DataFrame:
    """(container_id, at, key, piece, begin, length): a place for every unit of every item.

    Repeated rows and rows of a null key are items of their own; items of null or no size need no place; only items longer than ``capacity`` are
    cut. ``at`` is the place within the container, ``begin`` the place within the item. Ties are ordered by
    key and piece, so the result doesn't depend on partitioning. Other columns are left out; an empty table
    gives no row.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = pieces(sizes, key, size, capacity).withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.lit(PARTS)).cast("int"))
    counts = items.groupBy("length", "_part").agg(F.count("*").alias("_count"))
    # At most capacity * PARTS counts.
    of_part = counts.toPandas().sort_values(["length", "_part"])
    hist = np.zeros(capacity + 1, np.int64)
    np.add.at(hist, of_part["length"].to_numpy(np.int64), of_part["_count"].to_numpy(np.int64))
    before = np.zeros((capacity + 1, PARTS), np.int64)
    before[of_part["length"].to_numpy(np.int64), of_part["_part"].to_numpy(np.int64)] = of_part["_count"].to_numpy(np.int64)
    before = np.cumsum(before, axis=1) - before
    shared = sizes.sparkSession.sparkContext.broadcast((plan(hist, capacity), before))
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(key, "piece")).cast("long") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first = shared.value
        code = p.length * (1 << 42) + p.rank
        for batch in batches:
            length, part, rank = (batch.column(i).to_numpy() for i in (3, 4, 5))
            rank = rank + first[length, part]
            row = np.searchsorted(code, length * (1 << 42) + rank, "right") - 1
            k = rank - p.rank[row]
            container, at = p.first[row] + k // p.each[row], p.at[row] + k % p.each[row] * length
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(at), *(batch.column(i) for i in range(4))], ["container_id", "at", key, "piece", "begin", "length"])

    kind = dict(sizes.dtypes)[key]
    return ranked.select(key, "piece", "begin", "length", "_part", "_rank").mapInArrow(run, f"container_id long, at long, `{key}` {kind}, piece int, begin long, length long")
