"""As-of joins through one window over tagged rows, and the latest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], *, strict: bool = True) -> DataFrame:
    """``left`` with ``values`` of the last ``right`` row of its keys before ``left_at`` (null if there is none).

    Both sides are tagged and united, so a key is sorted once; no range join. Of right rows at the same time the
    greatest values count. Left rows with null keys or time are kept without a match.
    """
    tagged_l = left.withColumns({"_at": F.col(left_at), "_tag": F.lit(0 if strict else 1), "_row": F.struct(*left.columns), "_hit": F.lit(None)})
    r = right.select(*keys, F.col(right_at).alias("_at"), F.struct(F.col(right_at).alias("_right_at"), *values).alias("_hit")).where(F.col("_at").isNotNull())
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    r = r.groupBy(*keys, "_at").agg(F.max("_hit").alias("_hit"))
    hit, row = r.schema["_hit"].dataType, tagged_l.schema["_row"].dataType
    united = tagged_l.select(*keys, "_at", "_tag", "_row", F.lit(None).cast(hit).alias("_hit")).unionByName(r.select(*keys, "_at", F.lit(1 - (0 if strict else 1)).alias("_tag"), F.lit(None).cast(row).alias("_row"), "_hit"))
    w = Window.partitionBy(*keys).orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = united.withColumn("_last", F.when(F.col("_at").isNotNull(), F.last("_hit", ignorenulls=True).over(w))).where(F.col("_row").isNotNull())
    return found.select("_row.*", F.col("_last._right_at").alias(f"{right_at}_matched"), *(F.col(f"_last.{v}").alias(v) for v in values))


def snapshot_status(facts: DataFrame, snapshots: DataFrame, keys: list[str], at: str, snapshot_at: str, source: str, priority: dict[str, int], entity: str, value: str, max_age: int) -> DataFrame:
    """Each fact's value from the last snapshot strictly before it, from the best of several sources.

    A source whose snapshot is at most ``max_age`` days old beats staler ones, then the priority decides. Gives
    the facts with ``source``, ``snapshot_at``, ``value`` and ``status``: no_snapshot, stale, unranked or ranked;
    only fresh lists give a value.
    """
    lists = snapshots.select(*keys, source, snapshot_at).distinct()
    sources = F.explode(F.array(*(F.lit(s) for s in priority)))
    moments = facts.select(*keys, at).distinct().withColumn(source, sources)
    dated = latest_before(moments, lists.withColumn("_one", F.lit(1)), [*keys, source], at, snapshot_at, ["_one"]).withColumnRenamed(f"{snapshot_at}_matched", "_snap")
    age = F.datediff(F.col(at), F.col("_snap"))
    rank = F.create_map(*[x for s, p in priority.items() for x in (F.lit(s), F.lit(p))])[F.col(source)]
    best = dated.where("_snap is not null").groupBy(*keys, at).agg(F.min_by(F.struct(source, F.col("_snap").alias("snap"), age.alias("age")), F.struct(age > max_age, rank)).alias("_b"))
    chosen = facts.join(best, [*keys, at], "left").select(*facts.columns, F.col(f"_b.{source}").alias(source), F.col("_b.snap").alias("snapshot_at"), F.col("_b.age").alias("_age"))
    held = snapshots.where(F.col(entity).isNotNull()).groupBy(*keys, source, F.col(snapshot_at).alias("snapshot_at"), entity).agg(F.min(value).alias("_v"))
    out = chosen.join(held, [*keys, source, "snapshot_at", entity], "left")
    status = F.when(F.col("snapshot_at").isNull(), "no_snapshot").when(F.col("_age") > max_age, "stale").when(F.col("_v").isNull(), "unranked").otherwise("ranked")
    return out.select(*facts.columns, source, "snapshot_at", F.when(status == "ranked", F.col("_v")).alias("value"), status.alias("status"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """``values`` of each key's greatest row by ``order``; combines before its shuffle, unlike a window."""
    best = F.max(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), *values))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *(F.col(f"_b.{v}").alias(v) for v in values))


def last_non_null(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """Each value from the last row that has one, oldest to newest, column by column."""
    return df.groupBy(*keys).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values))
