"""Two-sided facts: one row for a pair of entities to one row for each side, and pair keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_key(a: str, b: str) -> tuple[Column, Column]:
    """The pair in neutral order (lo, hi); null if either is."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def explode_sides(df: DataFrame, a: str, b: str, side: str = "side", entity: str = "entity", opponent: str = "opponent") -> DataFrame:
    """One row for each side in a single scan; a side without entity gives no row. Also rewrites joins whose
    condition is ``x = a OR x = b`` into an equi join."""
    one = lambda s, x, y: F.struct(F.lit(s).alias(side), F.col(x).alias(entity), F.col(y).alias(opponent))
    out = df.withColumn("_s", F.explode(F.array(one("a", a, b), one("b", b, a))))
    return out.select(*df.columns, f"_s.{side}", f"_s.{entity}", f"_s.{opponent}").where(F.col(entity).isNotNull())


def perspective(entity: Column, winner: Column, outcome: Column) -> Column:
    """win, loss, draw, nc or unknown from one side's view."""
    o = F.lower(F.trim(outcome))
    return (
        F.when((o == "win") & winner.isNull(), "unknown")
        .when(o == "win", F.when(winner == entity, "win").otherwise("loss"))
        .when(o == "draw", "draw")
        .when(o.isin("no_contest", "no contest", "nc"), "nc")
        .otherwise("unknown")
    )
