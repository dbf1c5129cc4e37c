"""Separation of records that fail to parse from the valid ones, with a reason for each (problem 1).

A record is split by its quotes without a regular expression over the whole line, so very long lines are
safe. Every distinct value of a column is cast once; the values that fail form a dictionary with their
reasons, which is joined back to the fields. Structure (quotes, column count) is checked on the line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the file layouts.
WEIGHT_CLASSES = (
    "Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight",
    "Heavyweight", "Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight",
    "Catch Weight", "Open Weight",
)
WINNERS = ("Red", "Blue", "Draw", "No Contest")
REGIONS = ("us", "eu", "uk", "au")
LAYOUTS: dict[str, tuple[tuple[str, str], ...]] = {
    "mdabbert": (("red_name", "name"), ("blue_name", "name"), ("bout_date", "day"), ("red_odds", "moneyline"), ("blue_odds", "moneyline"), ("winner", "winner"), ("weight_class", "weight_class")),
    "odds_feed": (("fight_url", "url"), ("name_1", "name"), ("name_2", "name"), ("odds_1", "price"), ("odds_2", "price"), ("event_date", "day"), ("added", "moment"), ("source", "name"), ("region", "region")),
    "rankings:weekly_list": (("snapshot_date", "day"), ("weight_class", "weight_class"), ("name_raw", "free"), ("rank", "rank")),
}

QUOTING, COLUMNS, LAYOUT = "quoting", "column count", "unknown layout"
#: Copies of the dictionary of invalid values; the fields of one very frequent value meet it in so many tasks.
SALTS = 16
_COMMA, _QUOTE = "\x01", "\x02"


def _is_day(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(v, "yyyy-MM-dd").isNotNull()


def _number(v: Column, pattern: str) -> Column:
    return F.when(v.rlike(pattern), v.try_cast("double"))


def value_reason(kind: Column, v: Column) -> Column:
    """Why the trimmed value ``v`` isn't one of ``kind``; null if it is."""
    moneyline = _number(v, r"^[+-]?\d+(\.\d+)?$")
    price = _number(v, r"^\d+(\.\d+)?$")
    rank = F.when(v.rlike(r"^\d+$"), v.try_cast("decimal(38,0)"))
    valid = (
        F.when(kind == "free", True)
        .when(kind == "name", v != "")
        .when(kind == "day", _is_day(v))
        .when(kind == "moment", (v == "") | _is_day(v) | (_is_day(F.substring(v, 1, 10)) & F.substring(v, 11, 1 << 30).rlike(r"^[T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")))
        .when(kind == "moneyline", (v == "") | (F.lower(v) == "nan") | (F.abs(moneyline) >= 100))
        .when(kind == "price", (v == "") | (price > 1))
        .when(kind == "winner", v.isin(*WINNERS))
        .when(kind == "region", v.isin(*REGIONS))
        .when(kind == "url", (v == "") | v.rlike(r"^https?://.*/[0-9a-f]{16}$"))
        .when(kind == "weight_class", v.isin(*WEIGHT_CLASSES))
        .when(kind == "rank", rank.between(0, 15))
    )
    return F.when(~F.coalesce(valid, F.lit(False)), F.concat(F.lit("invalid value: "), kind))


def split_record(line: Column) -> Column:
    """Trimmed fields of a record, null if its quotes are broken or the line is null.

    ``line`` is cut at its quotes: pieces of odd index are inside. An empty piece between two quoted ones
    is a doubled quote; any other outside piece must end with a comma before a quote and begin with one
    after it, blanks aside.
    """
    parts = F.split(line, '"', -1)
    n = F.size(parts)
    # Lambdas see only their element and its place, so no line is split more than a few times, however long.
    first, last, middle = parts[0], F.element_at(parts, -1), F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0)))
    blank = lambda p: F.regexp_replace(p, r"\s+", "")
    masked = F.transform(middle, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", _COMMA)).when(p == "", F.lit(_QUOTE)).otherwise(p))
    between = F.forall(F.transform(middle, lambda p, i: (i % 2 == 0) | (p == "") | (blank(p).startswith(",") & blank(p).endswith(","))), lambda ok: ok)
    ends = ((blank(first) == "") | blank(first).endswith(",")) & ((blank(last) == "") | blank(last).startswith(","))
    ok = (n == 1) | ((n % 2 == 1) & between & ends)
    fields = F.split(F.when(n == 1, first).otherwise(F.concat(first, F.array_join(masked, ""), last)), ",", -1)
    trim = lambda f: F.regexp_replace(F.translate(f, _COMMA + _QUOTE, ',"'), r"^\s+|\s+$", "")
    return F.when(ok, F.transform(fields, trim))


@dataclass(frozen=True)
class Parsed:
    """``fields`` has key columns, layout, and for structurally sound records the array of fields;
    ``rejected`` has the key columns, ``reason`` and ``field`` of every record that is not valid."""

    fields: DataFrame
    rejected: DataFrame

    def loaded(self, keys: list[str], layout: str) -> DataFrame:
        """The valid records of one layout as columns of text, trimmed."""
        names = [c for c, _ in LAYOUTS[layout]]
        good = self.fields.where((F.col("_layout") == layout) & F.col("_fields").isNotNull()).join(self.rejected.select(*keys), keys, "left_anti")
        return good.select(*keys, *(F.col("_fields")[i].alias(c) for i, c in enumerate(names)))


def parse_records(records: DataFrame, keys: list[str], line: str, layout: str) -> Parsed:
    """Checks ``records``: ``keys`` name a record, ``line`` holds it, ``layout`` names its file layout.

    Null or empty lines have a wrong column count; a layout that is not known, or null, rejects the
    record; repeated keys are checked one by one and reported once; other columns are left out, so
    clashing names don't matter; an empty table gives empty results.
    """
    kinds = F.create_map(*[x for name, cols in LAYOUTS.items() for x in (F.lit(name), F.array(*(F.lit(k) for _, k in cols)))])
    base = records.select(*keys, F.col(line).alias("_line"), F.col(layout).alias("_layout")).withColumn("_kinds", kinds[F.col("_layout")])
    cut = base.withColumn("_fields", split_record(F.coalesce("_line", F.lit(""))))
    cut = cut.withColumn(
        "_why",
        F.when(F.col("_kinds").isNull(), LAYOUT)
        .when(F.col("_fields").isNull(), QUOTING)
        .when(F.size("_fields") != F.size("_kinds"), COLUMNS),
    )
    # A distinct value costs one cast, whatever its count; the distinct combines before it shuffles.
    cells = cut.where(F.col("_why").isNull()).select(*keys, F.posexplode(F.arrays_zip(F.col("_kinds").alias("kind"), F.col("_fields").alias("value")))).select(*keys, "pos", "col.kind", "col.value")
    bad = cells.select("kind", "value").where(F.col("kind") != "free").distinct().withColumn("reason", value_reason(F.col("kind"), F.col("value"))).where(F.col("reason").isNotNull())
    bad = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = cells.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    by_value = salted.join(bad, ["kind", "value", "_salt"]).groupBy(*keys).agg(F.min_by(F.struct("reason", "pos"), "pos").alias("_r"))
    by_value = by_value.select(*keys, F.col("_r.reason").alias("reason"), F.col("_r.pos").alias("field"))
    structural = cut.where(F.col("_why").isNotNull()).groupBy(*keys).agg(F.min("_why").alias("reason")).withColumn("field", F.lit(None).cast("int"))
    rejected = structural.unionByName(by_value).groupBy(*keys).agg(F.min_by(F.struct("reason", "field"), F.coalesce("field", F.lit(-1))).alias("_r")).select(*keys, "_r.reason", "_r.field")
    return Parsed(cut.select(*keys, "_layout", "_fields"), rejected)


def run_counts(parsed: Parsed, records: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """``rows_read``, ``rows_loaded`` and ``rows_rejected`` of each run."""
    read = records.select(*keys).distinct().groupBy(run).agg(F.count("*").alias("rows_read"))
    out = parsed.rejected.groupBy(run).agg(F.count("*").alias("rows_rejected"))
    rejected = F.coalesce("rows_rejected", F.lit(0))
    return read.join(out, run, "left").select(run, "rows_read", (F.col("rows_read") - rejected).alias("rows_loaded"), rejected.alias("rows_rejected"))
