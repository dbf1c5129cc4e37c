"""Aggregations beyond plain groupBy: fingerprints, reconciliation, histogram quantiles, consensus, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_text(columns: list[Column]) -> Column:
    """Unambiguous text of a row; nulls are marked."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns))


def fingerprint(df: DataFrame, columns: list[Column], version: str = "1", parts: int = 256) -> DataFrame:
    """One hash of a table's content that doesn't depend on row order or partitioning.

    Rows are hashed, row hashes are sorted within ``parts`` ranges of their prefix, the ranges' hashes are hashed.
    So no task holds all rows; a range holds 1 / parts of them, as hashes only.
    """
    hashed = df.select(F.sha2(row_text(columns), 256).alias("h"))
    width = 2 if parts == 256 else 3
    ranges = hashed.groupBy(F.substring("h", 1, width).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("ph"), F.count("*").alias("n"))
    return ranges.agg(F.sha2(F.concat(F.lit(version + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "ph"))), lambda x: x["ph"]), "\n")), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def drop_repeated_groups(df: DataFrame, key: list[str], group: str) -> DataFrame:
    """Rows without the groups in which some key occurs twice."""
    bad = df.groupBy(*key).count().where("count > 1").select(group).distinct()
    return df.join(bad, group, "left_anti")


def reconcile_sums(parts: DataFrame, totals: DataFrame, keys: list[str], columns: list[str], *, null_as_zero: bool) -> DataFrame:
    """(keys, column, part_sum, total) where the parts don't add up. Null parts count as zero or are skipped;
    with skipping, a null total or no known part isn't compared."""
    value = (lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))) if null_as_zero else (lambda c: F.sum(c))
    s = parts.groupBy(*keys).agg(*(value(c).alias(f"_s_{c}") for c in columns))
    j = totals.join(s, keys)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_s_{c}").alias("part_sum"), F.col(c).alias("total")) for c in columns))
    return j.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*").where("part_sum <> total")


def histogram_quantile(buckets: DataFrame, keys: list[str], le: str, cumulative: str, q: float) -> DataFrame:
    """Quantile of cumulative buckets with linear interpolation; in the last (+Inf) bucket its lower bound."""
    w = Window.partitionBy(*keys).orderBy(le)
    whole = Window.partitionBy(*keys)
    b = buckets.withColumns({"_lo": F.coalesce(F.lag(le).over(w), F.lit(0.0)), "_before": F.coalesce(F.lag(cumulative).over(w), F.lit(0)), "_rank": F.max(cumulative).over(whole) * q})
    hit = b.where((F.col(cumulative) >= F.col("_rank")) & (F.col("_rank") > 0)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    inside = F.col("_lo") + (F.col(le) - F.col("_lo")) * F.try_divide(F.col("_rank") - F.col("_before"), F.col(cumulative) - F.col("_before"))
    return hit.select(*keys, F.when(F.col(le) == float("inf"), F.col("_lo")).otherwise(inside).alias("quantile"))


def counter_delta(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Growth of counters between two snapshots, summed over workers; a counter that is new counts from zero."""
    s = lambda d, n: d.groupBy(*keys).agg(F.sum(value).alias(n))
    return s(after, "_a").join(s(before, "_b"), keys, "left").select(*keys, (F.col("_a") - F.coalesce("_b", F.lit(0))).alias("delta"))


def consensus(prices: DataFrame, group: list[str], quote: list[str], at: str, tie: str, probability: Column) -> DataFrame:
    """Mean probability of the last quote of each source of a group, with the number of quotes and the last time."""
    last = prices.withColumn("_p", probability).where("_p is not null").groupBy(*group, *quote).agg(F.max(F.struct(at, tie, "_p")).alias("_l"))
    return last.groupBy(*group).agg(F.avg("_l._p").alias("probability"), F.count("*").alias("quotes"), F.max(f"_l.{at}").alias("freshest"))


def equal_count_bins(df: DataFrame, by: Column, tie: str, bins: int, y: str, p: str) -> DataFrame:
    """Calibration table: rows in ``bins`` parts of equal count (larger parts first), mean p and y of each.

    The position comes from counts of ranges of the sort key, so no single task sorts all rows.
    """
    ranked = rank_globally(df.withColumn("_k", by), ["_k", tie])
    n = df.count()
    big, size = n % bins, n // bins
    edge = big * (size + 1)
    pos = F.col("_pos")
    b = F.when(pos < edge, F.floor(pos / F.lit(size + 1))).otherwise(big + F.floor((pos - edge) / F.lit(max(size, 1))))
    return ranked.groupBy((b + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def rank_globally(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_pos``, its 0-based position in a total order, without a single-partition window.

    Rows are sorted by range; positions are those within a partition plus the counts of partitions before,
    which are as many as there are partitions.
    """
    from tallyspan.session import cut

    s = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_off", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_off")
    return s.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_pos", F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_off")


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage on decimals, so that rounding is exact; null for an empty whole."""
    return F.round(F.try_divide(part.cast("decimal(20,0)") * 100, F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))), digits).cast("double")
