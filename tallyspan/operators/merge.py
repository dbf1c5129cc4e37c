"""Merges with a policy for each column, reconciliation and precedence between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A batch holds a key more than once."""


def reject_duplicates(batch: DataFrame, key: list[str]) -> None:
    bad = batch.groupBy(*key).count().where("count > 1").limit(5).collect()
    if bad:
        raise DuplicateKeys(f"repeated keys, for example {[tuple(r[k] for k in key) for r in bad]}")


def policy_merge(held: DataFrame, batch: DataFrame, key: list[str], *, replace: list[str] = (), fill: list[str] = (), sticky_true: list[str] = (), only_if: Column | None = None) -> DataFrame:
    """Held and new rows merged: key, columns, ``action`` (inserted, updated, unchanged, kept).

    ``replace`` takes the new value even if null, ``fill`` only if it isn't null, ``sticky_true`` stays true once
    true. ``only_if`` is a condition on the held row (its columns as ``held.x``); rows it refuses, or rows whose
    values don't change, are ``unchanged``; held rows without new ones are ``kept``. Keys must be unique in the
    batch (see `reject_duplicates`) and not null.
    """
    cols = [*replace, *fill, *sticky_true]
    a = held.select(*key, F.struct(*cols).alias("held"))
    b = batch.select(*key, F.struct(*cols).alias("new"))
    both = a.join(b, key, "full_outer")

    def merged(c: str) -> Column:
        old, new = F.col(f"held.{c}"), F.col(f"new.{c}")
        if c in replace:
            return new
        if c in fill:
            return F.coalesce(new, old)
        return F.when(old | new, True).otherwise(F.coalesce(new, old))

    target = F.struct(*(merged(c).alias(c) for c in cols))
    allowed = F.lit(True) if only_if is None else F.coalesce(only_if, F.lit(False))
    action = (
        F.when(F.col("held").isNull(), "inserted")
        .when(F.col("new").isNull(), "kept")
        .when(allowed & ~target.eqNullSafe(F.col("held")), "updated")
        .otherwise("unchanged")
    )
    out = both.withColumns({"_t": target, "action": action})
    pick = F.when(F.col("action") == "inserted", F.col("new")).when(F.col("action") == "updated", F.col("_t")).otherwise(F.col("held"))
    return out.withColumn("_p", pick).select(*key, *(F.col(f"_p.{c}").alias(c) for c in cols), "action")


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))


def insert_missing(held: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Held rows untouched, plus new rows of keys that aren't held; of repeated new keys the last by ``order``."""
    best = batch.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*(o.desc() for o in order)))).where("_rn = 1").drop("_rn")
    return held.unionByName(best.join(held.select(*key), key, "left_anti").select(*held.columns))


def refresh_partition(held: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """``held`` with all rows of the partitions that the batch has replaced by it."""
    return held.join(batch.select(column).distinct(), column, "left_anti").select(*held.columns).unionByName(batch.select(*held.columns))


def delete_missing(held: DataFrame, listed: DataFrame, key: list[str], touched: list[str]) -> DataFrame:
    """Held rows without those that a touched group no longer lists; groups that list nothing keep theirs."""
    gone = held.join(listed.select(*touched).distinct(), touched, "left_semi").join(listed.select(*key), key, "left_anti")
    return held.join(gone.select(*key), key, "left_anti").select(*held.columns)


def reconcile(held: DataFrame, listed: DataFrame, group: str, key: str, status: str = "status") -> DataFrame:
    """Scheduled rows that their group no longer lists become cancelled; completed ones are reported.

    Gives held rows with the new status and ``anomaly`` (``missing_completed`` or null). A group that lists nothing
    at all is left alone.
    """
    groups = listed.select(group).distinct().withColumn("_g", F.lit(True))
    there = listed.select(group, key).distinct().withColumn("_k", F.lit(True))
    j = held.join(groups, group, "left").join(there, [group, key], "left")
    missing = F.col("_g") & F.col("_k").isNull()
    new = F.when(missing & (F.col(status) == "scheduled"), "cancelled").otherwise(F.col(status))
    odd = F.when(missing & (F.col(status) == "completed"), "missing_completed")
    return j.select(*(F.col(c) if c != status else new.alias(status) for c in held.columns), odd.alias("anomaly"))


def precedence_merge(primary: DataFrame, secondary: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows of both sources by key; the primary is never replaced, and what the secondary says otherwise is listed.

    Gives key, values, ``source`` and ``disagreements``: names of columns that both know and that differ.
    """
    a = primary.select(*key, F.struct(*values).alias("p"))
    b = secondary.select(*key, F.struct(*values).alias("s"))
    j = a.join(b, key, "full_outer")
    pick = F.coalesce("p", "s")
    odd = F.filter(F.array(*(F.when(F.col(f"p.{v}").isNotNull() & F.col(f"s.{v}").isNotNull() & (F.col(f"p.{v}") != F.col(f"s.{v}")), F.lit(v)) for v in values)), lambda x: x.isNotNull())
    return j.select(*key, *(pick[v].alias(v) for v in values), F.when(F.col("p").isNotNull(), "primary").otherwise("secondary").alias("source"), odd.alias("disagreements"))


def changes(old: str, new: str, columns: list[str]) -> Column:
    """Names of the columns in which two structs differ, null-safe."""
    return F.filter(F.array(*(F.when(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())


def violations(df: DataFrame, key: list[str], constraints: dict[str, str]) -> DataFrame:
    """(key, constraint) of rows that break one; as in SQL, a check that comes out null is passed."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in constraints.items())), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("constraint"))


def anomalies_by_kind(df: DataFrame, column: str) -> DataFrame:
    """Counts of anomalies ``kind:detail`` held as an array column."""
    return df.select(F.explode(column).alias("a")).groupBy(F.split("a", ":", 2)[0].alias("kind")).agg(F.count("*").alias("n"))
