"""Attributes as known at the time of an event, from path-copied persistent search trees (problem 6).

An entity's versions are inserted in the order in which they became known. Each insertion copies the path
from the root to the changed node, so every earlier root stays whole. An event takes the last root that was
known before its moment and searches there for the valid-time key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.operators.cogrouped import by_bucket
from tallyspan.session import buckets_for

# A node is (key, priority, value, left, right); the priority is a hash of the key, which balances the tree.
_MASK = (1 << 64) - 1


def _priority(key: int) -> int:
    x = (key * 0x9E3779B97F4A7C15) & _MASK
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9) & _MASK


def insert(node: tuple | None, key: int, value: object, priority: int | None = None) -> tuple:
    """Root of a tree that also has ``key``; a present key gets the new value. ``node`` is unchanged."""
    p = _priority(key) if priority is None else priority
    if node is None:
        return (key, p, value, None, None)
    k, q, v, left, right = node
    if key == k:
        return (k, q, value, left, right)
    if key < k:
        c = insert(left, key, value, p)
        if c[1] > q:
            return (c[0], c[1], c[2], c[3], (k, q, v, c[4], right))
        return (k, q, v, c, right)
    c = insert(right, key, value, p)
    if c[1] > q:
        return (c[0], c[1], c[2], (k, q, v, left, c[3]), c[4])
    return (k, q, v, left, c)


def find(node: tuple | None, key: int) -> tuple | None:
    while node is not None and node[0] != key:
        node = node[3] if key < node[0] else node[4]
    return node


def before(node: tuple | None, key: int) -> tuple | None:
    """The node with the largest key below ``key``."""
    best = None
    while node is not None:
        if node[0] < key:
            best, node = node, node[4]
        else:
            node = node[3]
    return best


def _segments(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the runs of a sorted array."""
    if len(ids):
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        for b, e in zip(at, np.r_[at[1:], len(ids)], strict=True):
            yield int(ids[b]), int(b), int(e)


def _search(exact: bool):
    """Function over a bucket: versions(entity, known, valid, value) and asked(entity, known, valid, ask)."""

    def run(versions: pa.Table, asked: pa.Table) -> pa.Table:
        a_ent, a_known, a_valid, a_ask = (asked.column(c).to_numpy() for c in ("entity", "known", "valid", "ask"))
        v_ent = versions.column("entity").to_numpy()
        use = np.flatnonzero(np.isin(v_ent, a_ent))
        v_ent, v_known, v_valid = (versions.column(c).to_numpy()[use] for c in ("entity", "known", "valid"))
        value = versions.column("value")
        v_null = np.asarray(value.is_null())[use]
        v_val = np.asarray(value.fill_null(0))[use]
        # Among versions known at one moment the smaller value is inserted last, so that it stays.
        order = np.lexsort((-v_val, ~v_null, v_known, v_ent))
        v_ent, v_known, v_valid, v_val, v_null = (x[order] for x in (v_ent, v_known, v_valid, v_val, v_null))
        a_order = np.argsort(a_ent, kind="stable")
        spans = {e: (b, t) for e, b, t in _segments(a_ent[a_order])}
        asks, valids, values = [], [], []
        for ent, b, t in _segments(v_ent):
            roots, known, root = [], [], None
            for k, key, val, gone in zip(v_known[b:t].tolist(), v_valid[b:t].tolist(), v_val[b:t].tolist(), v_null[b:t].tolist(), strict=True):
                root = insert(root, key, None if gone else val)
                roots.append(root)
                known.append(k)
            lo, hi = spans[ent]
            for i in a_order[lo:hi].tolist():
                at = bisect_left(known, a_known[i])
                if at:
                    node = (find if exact else before)(roots[at - 1], int(a_valid[i]))
                    if node is not None:
                        asks.append(a_ask[i])
                        valids.append(node[0])
                        values.append(node[2])
        return pa.table({"ask": pa.array(asks, pa.int64()), "valid": pa.array(valids, pa.int64()), "value": pa.array(values, pa.int64())})

    return run


def as_known(versions: DataFrame, asked: DataFrame, *, exact: bool, rows: int) -> DataFrame:
    """For each question the version that was known strictly before its moment.

    ``versions``: entity, known, valid, value (all long; value may be null). ``asked``: entity, known,
    valid, ask (long; ``ask`` is handed through). With ``exact`` the version of that valid-time key, else
    of the largest key below it. Gives (ask, valid, value); a question without an answer gives no row.
    Of versions known at the same moment for one key, the smaller value counts; rows with a null entity,
    known or valid can't be known and are left out. Entities are spread over hash buckets of bounded size.
    """
    n = buckets_for(versions.sparkSession, rows)
    whole = lambda d, last: d.where("entity is not null and known is not null and valid is not null").select("entity", "known", "valid", last)
    # Copies of a version are one version; they combine before the shuffle, so a frequent copy fills no task.
    once = whole(versions, "value").groupBy("entity", "known", "valid").agg(F.min("value").alias("value"))
    return by_bucket(once, whole(asked, "ask"), F.col("entity"), F.col("entity"), n, _search(exact), "ask long, valid long, value long")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def rank_as_known(features: DataFrame, fights: DataFrame, events: DataFrame, rankings: DataFrame) -> DataFrame:
    """(fight_id, fighter_id, source, rank): what the newest list known before the bout's day said.

    A list is (circuit, source, weight class) of type ``division``. First, lists: the snapshots of a list,
    each known since its first row, give the newest one known on each day asked for. They are aggregated
    before they are shuffled, so a hot list is only as large as its number of snapshots. Second, fighters:
    each (list, fighter) has its own tree, so a hot list is spread over its fighters. Null days, classes or
    fighters give no row; repeated feature rows give one; a known row with a null rank gives a null rank.
    """
    bouts = (
        features.select("fight_id", "fighter_id", "weight_class")
        .where("fighter_id is not null and weight_class is not null")
        .distinct()
        .join(fights.select(F.col("id").alias("fight_id"), "event_id"), "fight_id")
        .join(events.select(F.col("id").alias("event_id"), "circuit_id", F.col("event_date").alias("day")), "event_id")
        .where("day is not null and circuit_id is not null")
        .select("fight_id", "fighter_id", "weight_class", "circuit_id", "day")
    )
    lists = ["circuit_id", "source", "weight_class"]
    known = rankings.where("ranking_type = 'division' and loaded_at is not null and snapshot_date is not null and source is not null and weight_class is not null")
    known = known.select(*lists, F.unix_date("snapshot_date").cast("long").alias("valid"), _micros(F.col("loaded_at")).alias("known"), "fighter_id", F.col("rank").cast("long").alias("value"))
    rows = rankings.count()
    snapshots = known.groupBy(*lists, "valid").agg(F.min("known").alias("known"))
    sources = known.select(*lists).distinct()
    day = F.unix_date("day").cast("long")
    asked = bouts.select("circuit_id", "weight_class", "day").distinct().join(sources, ["circuit_id", "weight_class"]).withColumn("ask", day)
    # The entity of a list is a hash of its name together with the day's question; both sides hash alike.
    of_list = F.xxhash64("circuit_id", "source", "weight_class")
    newest = as_known(
        snapshots.select(of_list.alias("entity"), "known", "valid", F.xxhash64("circuit_id", "source", "weight_class").alias("value")),
        asked.select(of_list.alias("entity"), _micros(F.col("day")).alias("known"), F.col("ask").alias("valid"), "ask"),
        exact=False,
        rows=rows,
    ).select(F.col("value").alias("list"), F.col("ask").alias("asked_day"), F.col("valid").alias("snapshot"))
    with_list = bouts.join(sources, ["circuit_id", "weight_class"]).withColumn("list", of_list).withColumn("asked_day", day)
    questions = with_list.join(newest, ["list", "asked_day"]).withColumn("ask", F.xxhash64("fight_id", "fighter_id", "source", "weight_class"))
    of_fighter = F.xxhash64("circuit_id", "source", "weight_class", "fighter_id")
    found = as_known(
        known.where("fighter_id is not null").select(of_fighter.alias("entity"), "known", "valid", "value"),
        questions.select(of_fighter.alias("entity"), _micros(F.col("day")).alias("known"), F.col("snapshot").alias("valid"), "ask"),
        exact=True,
        rows=rows,
    )
    return questions.select("fight_id", "fighter_id", "source", "ask").join(found.select("ask", F.col("value").alias("rank")), "ask").select("fight_id", "fighter_id", "source", "rank").distinct()
