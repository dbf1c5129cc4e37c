"""One surviving record of each group of duplicates, taken field by field (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivor(value: Column, usable: Column, ranks: list[Column]) -> Column:
    """Aggregate: ``value`` of the best row that is ``usable``; null if no row is.

    The best row has the greatest struct (usable, ranks..., value); nulls rank last, and rows that tie in all
    ranks give the greatest value, so the result doesn't depend on their order.
    """
    ok = F.coalesce(usable, F.lit(False)) & value.isNotNull()
    best = F.max(F.struct(ok.alias("ok"), *(r.alias(f"r{i}") for i, r in enumerate(ranks)), value.alias("value")))
    return F.when(best["ok"], best["value"])


def survivors(rows: DataFrame, group: list[str], fields: dict[str, Column], ranks: list[Column], **others: Column) -> DataFrame:
    """One record of each group, each field from the best row that has it, in a single aggregation.

    ``fields`` maps a name to the value or null where a row has none; ``others`` are further aggregates.
    A field that no row has is null. The aggregation combines before its shuffle, so a group of any size is
    one partial record for each task.
    """
    return rows.groupBy(*group).agg(*(survivor(v, F.lit(True), ranks).alias(n) for n, v in fields.items()), *(v.alias(n) for n, v in others.items()))


def canonical_outcome(outcome: Column) -> Column:
    """win, draw or no_contest whatever the spelling; null for others."""
    o = F.regexp_replace(F.lower(F.trim(outcome)), r"[\s_\-]+", " ")
    return F.when(o.isin("win", "draw"), o).when(o.isin("no contest", "nc", "n c"), "no_contest")


def bout_groups(fights: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of fights with their pair (lo, hi), day and ``run``: the number of the group among the pair's bouts.

    Rows of one pair are one bout while each is at most a day after the one before. Rows without a day or a
    fighter belong to no group and are left out. A day counts once for each pair before the window sorts, so
    repeats of one bout are not gathered in a task.
    """
    lo, hi = F.least("fighter_a_id", "fighter_b_id"), F.greatest("fighter_a_id", "fighter_b_id")
    rows = fights.where("fighter_a_id is not null and fighter_b_id is not null").join(events.select(F.col("id").alias("event_id"), F.col("event_date").alias("day")), "event_id").where("day is not null").withColumns({"lo": lo, "hi": hi})
    per_pair = Window.partitionBy("lo", "hi").orderBy("day")
    days = rows.groupBy("lo", "hi", "day").agg(F.count("*").alias("n"))
    new = F.coalesce((F.datediff("day", F.lag("day").over(per_pair)) > 1).cast("int"), F.lit(0))
    runs = days.withColumn("_new", new).withColumn("run", F.sum("_new").over(per_pair)).select("lo", "hi", "day", "run")
    return rows.join(runs, ["lo", "hi", "day"])


def surviving_bouts(fights: DataFrame, events: DataFrame) -> DataFrame:
    """(group_id, outcome, winner_id) of each bout held in more than one row.

    Rows rank by source (ufcstats, wikipedia, others), then by ``loaded_at``, later first and null last. The
    outcome is that of the first row that knows one, else ``unknown``. A win's winner comes from the first
    row with a win and a winner who is one of the two; otherwise it is 0. A repeated row counts as a row.
    """
    rows = bout_groups(fights.select("id", "event_id", "fighter_a_id", "fighter_b_id", "result_source", "outcome", "winner_id", "loaded_at"), events)
    trust = F.when(F.col("result_source") == "ufcstats", 2).when(F.col("result_source") == "wikipedia", 1).otherwise(0)
    ranks = [trust, F.col("loaded_at"), -F.col("id")]
    known = canonical_outcome(F.col("outcome"))
    winner = F.when((known == "win") & F.col("winner_id").isin(F.col("lo"), F.col("hi")), F.col("winner_id"))
    out = survivors(rows, ["lo", "hi", "run"], {"outcome": known, "winner": winner}, ranks, group_id=F.min("id"), n=F.count("*"))
    return out.where("n > 1").select("group_id", F.coalesce("outcome", F.lit("unknown")).alias("outcome"), F.when((F.col("outcome") == "win") & F.col("winner").isNotNull(), F.col("winner")).otherwise(F.lit(0)).cast("long").alias("winner_id"))
