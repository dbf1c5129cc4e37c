"""Point-in-time features: every value of a row comes from strictly earlier days of the same entity.

All functions share one window specification, (entity; day, tie), so Spark plans one exchange and one sort for
any number of features. Values strictly before a day are taken at the first row of the day and handed to its
peers, so same-day rows never see each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNBOUNDED = Window.unboundedPreceding


def strictly_before(entity: str, day: str):
    """Window over all rows of the entity on earlier days."""
    return Window.partitionBy(entity).orderBy(F.unix_date(day)).rangeBetween(UNBOUNDED, -1)


def _ordered(entity: str, day: str, tie: str):
    return Window.partitionBy(entity).orderBy(day, tie)


def of_day(value: Column, entity: str, day: str, tie: str) -> Column:
    """The value that the first row of each (entity, day) has, for all rows of that day."""
    return F.first(value).over(Window.partitionBy(entity, day).orderBy(tie).rowsBetween(UNBOUNDED, 0))


def career(df: DataFrame, entity: str, day: str, **aggregates: Column) -> DataFrame:
    """Adds aggregates over the entity's earlier days; rows of a null entity or day see nothing earlier."""
    w = strictly_before(entity, day)
    return df.withColumns({n: a.over(w) for n, a in aggregates.items()})


def career_split(df: DataFrame, entity: str, day: str, *, sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, span_days: int = 90) -> DataFrame:
    """`career` for sums and maxima where one entity may hold a great part of all rows.

    An entity is cut into spans of days: aggregates of whole spans, combined before their shuffle, are summed up
    over earlier spans, and only the rows of one span are windowed together. A count is the sum of 1; sums and
    maxima of no row are null. Rows of a null entity or day see nothing earlier.
    """
    sums, highs = sums or {}, highs or {}
    values = {f"_v_{n}": c for n, c in (sums | highs).items()}
    base = df.withColumns(values | {"_span": F.floor(F.unix_date(day) / F.lit(span_days))})
    kind = lambda n: F.sum if n in sums else F.max
    whole = base.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity, "_span").agg(*(kind(n)(f"_v_{n}").alias(f"_w_{n}") for n in sums | highs))
    earlier = Window.partitionBy(entity).orderBy("_span").rowsBetween(UNBOUNDED, -1)
    before = whole.select(entity, "_span", *(kind(n)(f"_w_{n}").over(earlier).alias(f"_b_{n}") for n in sums | highs))
    inside = Window.partitionBy(entity, "_span").orderBy(F.unix_date(day)).rangeBetween(UNBOUNDED, -1)
    out = base.withColumns({f"_i_{n}": kind(n)(f"_v_{n}").over(inside) for n in sums | highs}).join(before, [entity, "_span"], "left")

    def joined(n: str) -> Column:
        a, b = F.col(f"_b_{n}"), F.col(f"_i_{n}")
        both = F.coalesce(a + b, a, b) if n in sums else F.greatest(a, b)
        return F.when(F.col(entity).isNotNull() & F.col(day).isNotNull(), both)

    return out.select(*df.columns, *(joined(n).alias(n) for n in sums | highs))


def trailing(df: DataFrame, entity: str, day: str, tie: str, n: int, **aggregates: Column) -> DataFrame:
    """Adds aggregates over the last ``n`` rows of earlier days. Rows without a value still use up a place."""
    last = _ordered(entity, day, tie).rowsBetween(-n, -1)
    raw = df.withColumns({f"_t_{k}": a.over(last) for k, a in aggregates.items()})
    return raw.withColumns({k: of_day(F.col(f"_t_{k}"), entity, day, tie) for k in aggregates}).drop(*(f"_t_{k}" for k in aggregates))


def ratio_of_sums(num: Column, den: Column) -> tuple[Column, Column]:
    """Aggregates (numerator, denominator) over rows where both are known; divide with `safe_ratio`."""
    both = num.isNotNull() & den.isNotNull()
    return F.sum(F.when(both, num)), F.sum(F.when(both, den))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is null or zero."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def streak(df: DataFrame, entity: str, day: str, tie: str, kind: Column, name: str = "streak") -> DataFrame:
    """Adds the run of ``win`` before each day: ``stop`` ends it, ``skip`` is passed over, ``unknown`` makes it null.

    No earlier row gives 0. The last stopper carries the wins up to itself, so one running maximum suffices.
    """
    w = _ordered(entity, day, tie)
    wins = F.sum((F.col("_kind") == "win").cast("long")).over(w.rowsBetween(UNBOUNDED, 0))
    base = df.withColumn("_kind", kind).withColumns({"_rn": F.row_number().over(w), "_wins": wins})
    stopper = F.when(F.col("_kind").isin("stop", "unknown") | F.col("_kind").isNull(), F.struct("_rn", F.coalesce("_kind", F.lit("unknown")).alias("k"), "_wins"))
    prior = w.rowsBetween(UNBOUNDED, -1)
    base = base.withColumns({"_stop": F.max(stopper).over(prior), "_before": F.coalesce(F.lag("_wins").over(w), F.lit(0))})
    run = F.when(F.col("_stop.k") == "unknown", None).otherwise(F.col("_before") - F.coalesce("_stop._wins", F.lit(0)))
    # A struct keeps the null of an unknown streak apart from a missing row.
    return base.withColumn("_run", F.struct(run.alias("v"))).withColumn(name, of_day(F.col("_run"), entity, day, tie)["v"]).drop("_kind", "_rn", "_wins", "_stop", "_before", "_run")


def days_since_last(entity: str, day: str) -> Column:
    return F.datediff(F.col(day), F.max(day).over(strictly_before(entity, day)))


def current_rows(df: DataFrame, entities: DataFrame, entity: str, day: str, tie: str, as_of: str) -> DataFrame:
    """History rows plus one synthetic row per entity at ``as_of`` (flag ``is_target``), for the same features.

    Entities without history get a row too. Its tie is null; later rows of the history stay and are ignored by
    the strictly-before windows.
    """
    blank = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes if c not in (entity, day)]
    target = entities.select(entity).distinct().select(entity, F.lit(as_of).cast("date").alias(day), *blank, F.lit(True).alias("is_target"))
    return df.withColumn("is_target", F.lit(False)).unionByName(target)


def recent(df: DataFrame, entity: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each entity in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def fight_duration(rounds: Column, finish_round: Column, finish_seconds: Column, method: Column) -> tuple[Column, Column]:
    """(seconds, reason): trusted duration of a bout, or null and why.

    Rounds last 300 s. A decision goes the distance; a finish lies within its round.
    """
    reason = (
        F.when(finish_round.isNull() | finish_seconds.isNull(), "no_finish_time")
        .when((finish_seconds < 0) | (finish_seconds > 300), "impossible_time")
        .when(rounds.isNull() | (rounds < 1), "unknown_rounds")
        .when((finish_round < 1) | (finish_round > rounds), "impossible_round")
        .when((method == "decision") & ((finish_round < rounds) | (finish_seconds < 300)), "decision_before_the_end")
    )
    return F.when(reason.isNull(), (finish_round - 1) * 300 + finish_seconds), reason
