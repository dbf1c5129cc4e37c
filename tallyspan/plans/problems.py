"""Queries p1, p2 and p6 over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.operators import bitemporal, differences, reject
from tallyspan.sources.tables import table

_RUN_KEYS = ["load_run_id", "line_no"]


def _parsed(spark: SparkSession, sf: str) -> tuple[reject.Parsed, DataFrame]:
    runs = table(spark, sf, "load_runs", "id", "source").select(F.col("id").alias("load_run_id"), "source")
    raw = table(spark, sf, "raw_records", *_RUN_KEYS, "raw_line").join(runs, "load_run_id", "left")
    return reject.parse_records(raw, _RUN_KEYS, "raw_line", "source"), raw


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)[0].rejected.select(*_RUN_KEYS)


def p1_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)[0].rejected.select(*_RUN_KEYS, F.regexp_replace("reason", ":.*", "").alias("reason"))


def p1_run_counts(spark: SparkSession, sf: str) -> DataFrame:
    parsed, raw = _parsed(spark, sf)
    return reject.run_counts(parsed, raw, "load_run_id", _RUN_KEYS)


def p1_loaded_mdabbert(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf)[0].loaded(_RUN_KEYS, "mdabbert")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return differences.bout_differences(table(spark, sf, "mdabbert_rows"), table(spark, sf, "fight_refs"), table(spark, sf, "fighters"), table(spark, sf, "verified_disagreements"))


def p2_order_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Two copies of orders, one of which lost, gained and changed rows, compared cell by cell."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    cents = orders.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long"))
    other = cents.withColumn("o_orderstatus", F.when(F.col("o_totalprice") % 7 == 0, None).otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_totalprice") % 11 == 0, "9-NONE").otherwise(F.col("o_orderpriority")))
    other = other.withColumn("o_orderkey", F.when(F.col("o_totalprice") % 13 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    out = differences.differences(cents, other, "o_orderkey", ["o_orderstatus", "o_totalprice", "o_orderpriority"])
    return out.withColumnRenamed("key", "o_orderkey")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return bitemporal.rank_as_known(table(spark, sf, "fight_features"), table(spark, sf, "fights"), table(spark, sf, "fight_events"), table(spark, sf, "rankings"))


QUERIES = {"p1_found": p1_found, "p1_rejected": p1_rejected, "p1_run_counts": p1_run_counts, "p1_loaded_mdabbert": p1_loaded_mdabbert, "p2_found": p2_found, "p2_order_copies": p2_order_copies, "p6_found": p6_found}

_P1_CTE = r"""
WITH base AS (
  SELECT r.load_run_id, r.line_no, coalesce(r.raw_line, '') AS line, l.source
  FROM raw_records r LEFT JOIN load_runs l ON l.id = r.load_run_id
), shape AS (
  SELECT *, CASE source WHEN 'mdabbert' THEN 7 WHEN 'odds_feed' THEN 9 WHEN 'rankings:weekly_list' THEN 4 END AS width,
    CASE source WHEN 'mdabbert' THEN ['name','name','day','moneyline','moneyline','winner','weight_class']
      WHEN 'odds_feed' THEN ['url','name','name','price','price','day','moment','name','region']
      WHEN 'rankings:weekly_list' THEN ['day','weight_class','free','rank'] END AS kinds,
    regexp_full_match(line, '(?s)(?:[^",]*|\s*"(?:[^"]|"")*"\s*)(?:,(?:[^",]*|\s*"(?:[^"]|"")*"\s*))*') AS quoted_ok
  FROM base
), cut AS (
  SELECT *, CASE WHEN quoted_ok THEN list_transform(regexp_extract_all(',' || line, '(?s),((?:\s*"(?:[^"]|"")*"\s*)|[^",]*)', 1),
     lambda f: CASE WHEN regexp_full_match(f, '(?s)\s*".*"\s*')
       THEN regexp_replace(replace(regexp_replace(f, '(?s)^\s*"(.*)"\s*$', '\1'), '""', '"'), '^\s+|\s+$', '', 'g')
       ELSE regexp_replace(f, '^\s+|\s+$', '', 'g') END) END AS fields
  FROM shape
), cells AS (
  SELECT load_run_id, line_no, unnest(kinds) AS kind, unnest(fields) AS v FROM cut WHERE quoted_ok AND len(fields) = width
), bad AS (
  SELECT DISTINCT load_run_id, line_no FROM cells WHERE NOT coalesce(CASE kind
    WHEN 'free' THEN true
    WHEN 'name' THEN v <> ''
    WHEN 'day' THEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}') AND try_cast(v AS DATE) IS NOT NULL
    WHEN 'moment' THEN v = '' OR (regexp_full_match(v, '\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3]):[0-5]\d:[0-5]\d)?') AND try_cast(v[1:10] AS DATE) IS NOT NULL)
    WHEN 'moneyline' THEN v = '' OR lower(v) = 'nan' OR (regexp_full_match(v, '[+-]?\d+(\.\d+)?') AND abs(try_cast(v AS DOUBLE)) >= 100)
    WHEN 'price' THEN v = '' OR (regexp_full_match(v, '\d+(\.\d+)?') AND try_cast(v AS DOUBLE) > 1)
    WHEN 'winner' THEN v IN ('Red','Blue','Draw','No Contest')
    WHEN 'region' THEN v IN ('us','eu','uk','au')
    WHEN 'url' THEN v = '' OR regexp_full_match(v, 'https?://.*/[0-9a-f]{16}')
    WHEN 'weight_class' THEN v IN ('Flyweight','Bantamweight','Featherweight','Lightweight','Welterweight','Middleweight','Light Heavyweight','Heavyweight','Women''s Strawweight','Women''s Flyweight','Women''s Bantamweight','Women''s Featherweight','Catch Weight','Open Weight')
    WHEN 'rank' THEN regexp_full_match(v, '\d+') AND try_cast(v AS HUGEINT) BETWEEN 0 AND 15 END, false)
), rejected AS (
  SELECT load_run_id, line_no, CASE WHEN width IS NULL THEN 'unknown layout' WHEN NOT quoted_ok THEN 'quoting'
    WHEN len(fields) <> width THEN 'column count' ELSE 'invalid value' END AS reason
  FROM cut WHERE width IS NULL OR NOT quoted_ok OR len(fields) <> width OR (load_run_id, line_no) IN (SELECT (load_run_id, line_no) FROM bad)
)
"""

ORACLE = {
    "p1_found": _P1_CTE + "SELECT load_run_id, line_no FROM rejected",
    "p1_rejected": _P1_CTE + "SELECT load_run_id, line_no, reason FROM rejected",
    "p1_run_counts": _P1_CTE
    + """SELECT b.load_run_id, count(*) AS rows_read, count(*) - count(r.line_no) AS rows_loaded, count(r.line_no) AS rows_rejected
FROM base b LEFT JOIN rejected r ON r.load_run_id = b.load_run_id AND r.line_no = b.line_no GROUP BY 1""",
    "p1_loaded_mdabbert": _P1_CTE
    + """SELECT load_run_id, line_no, fields[1] AS red_name, fields[2] AS blue_name, fields[3] AS bout_date, fields[4] AS red_odds, fields[5] AS blue_odds, fields[6] AS winner, fields[7] AS weight_class
FROM cut WHERE source = 'mdabbert' AND (load_run_id, line_no) NOT IN (SELECT (load_run_id, line_no) FROM rejected)""",
    "p2_order_copies": """
WITH l AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS p, o_orderpriority FROM orders),
r AS (SELECT CASE WHEN p % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN p % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, p,
  CASE WHEN p % 11 = 0 THEN '9-NONE' ELSE o_orderpriority END AS o_orderpriority FROM l)
SELECT o_orderkey, 'missing_right' AS field, NULL AS left_value, NULL AS right_value FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)
UNION ALL SELECT o_orderkey, 'missing_left', NULL, NULL FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l)
UNION ALL SELECT o_orderkey, 'o_orderstatus', l.o_orderstatus, r.o_orderstatus FROM l JOIN r USING (o_orderkey) WHERE l.o_orderstatus IS DISTINCT FROM r.o_orderstatus
UNION ALL SELECT o_orderkey, 'o_totalprice', l.p::VARCHAR, r.p::VARCHAR FROM l JOIN r USING (o_orderkey) WHERE l.p IS DISTINCT FROM r.p
UNION ALL SELECT o_orderkey, 'o_orderpriority', l.o_orderpriority, r.o_orderpriority FROM l JOIN r USING (o_orderkey) WHERE l.o_orderpriority IS DISTINCT FROM r.o_orderpriority""",
    "p6_found": """
WITH bouts AS (
  SELECT DISTINCT ff.fight_id, ff.fighter_id, ff.weight_class, e.circuit_id, e.event_date AS day
  FROM fight_features ff JOIN fights f ON f.id = ff.fight_id JOIN fight_events e ON e.id = f.event_id
  WHERE ff.weight_class IS NOT NULL AND e.event_date IS NOT NULL
), known AS (
  SELECT b.fight_id, b.fighter_id, b.day, r.source, r.snapshot_date, r.fighter_id AS ranked, r.rank, r.loaded_at
  FROM bouts b JOIN rankings r ON r.circuit_id = b.circuit_id AND r.weight_class = b.weight_class AND r.ranking_type = 'division'
   AND r.snapshot_date < b.day AND r.loaded_at < b.day::TIMESTAMP AT TIME ZONE 'UTC'
), newest AS (
  SELECT *, max(snapshot_date) OVER (PARTITION BY fight_id, fighter_id, source) AS last FROM known
)
SELECT DISTINCT fight_id, fighter_id, source, first_value(rank) OVER (PARTITION BY fight_id, fighter_id, source ORDER BY loaded_at DESC, rank)::BIGINT AS rank
FROM newest WHERE snapshot_date = last AND ranked = fighter_id""",
}
