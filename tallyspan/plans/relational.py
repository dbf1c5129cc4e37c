"""Queries on the star schema and events: filters, joins, aggregates, windows, merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.functions import domain, text
from tallyspan.operators import aggregate, asof, limits, matching, merge, pit, sides
from tallyspan.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.unix_micros("ts").alias("us"), "ts", F.col("user_id").alias("usr"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"), "props")


O = "WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderdate::DATE AS day, round(o_totalprice * 100)::BIGINT AS cents, o_orderstatus AS status, o_orderpriority AS prio FROM orders)"
E = "WITH e AS (SELECT event_id AS id, epoch_us(ts) AS us, ts, user_id AS usr, event_type AS kind, round(value * 100)::BIGINT AS cents, props FROM events)"


# --- point in time -------------------------------------------------------------------------------------------


@query(O + " SELECT id, (SELECT count(*) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS n_prior, (SELECT sum(cents) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS sum_prior, (SELECT max(cents) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS max_prior, date_diff('day', (SELECT max(day) FROM o p WHERE p.cust = o.cust AND p.day < o.day), day)::INT AS days_since FROM o")
def pit_career_prior(spark, sf):
    o = pit.career(_orders(spark, sf), "cust", "day", n_prior=F.count("*"), sum_prior=F.sum("cents"), max_prior=F.max("cents"))
    return o.withColumn("days_since", pit.days_since_last("cust", "day")).select("id", "n_prior", "sum_prior", "max_prior", "days_since")


@query(O + " SELECT id, (SELECT count(*) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS n_prior, (SELECT sum(cents) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS sum_prior, (SELECT max(cents) FROM o p WHERE p.cust = o.cust AND p.day < o.day)::BIGINT AS max_prior FROM o")
def pit_career_split(spark, sf):
    """The same for entities of any size, cut into spans of days."""
    o = pit.career_split(_orders(spark, sf), "cust", "day", sums={"n": F.lit(1), "sum_prior": F.col("cents")}, highs={"max_prior": F.col("cents")})
    return o.select("id", F.coalesce("n", F.lit(0)).alias("n_prior"), "sum_prior", "max_prior")


def _last(n: int) -> str:
    return O + f" SELECT id, l.n::BIGINT AS n_last, l.s::BIGINT AS sum_last FROM o, LATERAL (SELECT count(*) AS n, sum(cents) AS s FROM (SELECT cents FROM o p WHERE p.cust = o.cust AND p.day < o.day ORDER BY p.day DESC, p.id DESC LIMIT {n})) l"


@query(_last(3))
def pit_last3_prior(spark, sf):
    return pit.trailing(_orders(spark, sf), "cust", "day", "id", 3, n_last=F.count("*"), sum_last=F.sum("cents")).select("id", "n_last", "sum_last")


@query(O + " SELECT id, l.r AS ratio FROM o, LATERAL (SELECT round(CASE WHEN sum(CASE WHEN status <> 'P' THEN 1 END) > 0 THEN sum(CASE WHEN status <> 'P' THEN cents END)::DOUBLE / sum(CASE WHEN status <> 'P' THEN 1 END) END, 4) AS r FROM (SELECT cents, status FROM o p WHERE p.cust = o.cust AND p.day < o.day ORDER BY p.day DESC, p.id DESC LIMIT 5)) l")
def pit_last5_ratio(spark, sf):
    """Mean price of the non-pending of the last five: a pending row has no value but takes a place."""
    known = F.when(F.col("status") != "P", 1)
    num, den = pit.ratio_of_sums(F.when(F.col("status") != "P", F.col("cents")), known)
    return pit.trailing(_orders(spark, sf), "cust", "day", "id", 5, num=num, den=den).select("id", F.round(pit.safe_ratio(F.col("num").cast("double"), F.col("den").cast("double")), 4).alias("ratio"))


@query(O + """ , k AS (SELECT *, CASE status WHEN 'F' THEN 'win' WHEN 'O' THEN 'stop' ELSE CASE WHEN prio = '5-LOW' THEN 'unknown' ELSE 'skip' END END AS kind FROM o)
SELECT id, CASE WHEN s.kind = 'unknown' THEN NULL ELSE (SELECT count(*) FROM k p WHERE p.cust = k.cust AND p.day < k.day AND p.kind = 'win' AND (s.id IS NULL OR (p.day, p.id) > (s.day, s.id))) END::BIGINT AS streak
FROM k LEFT JOIN LATERAL (SELECT id, day, kind FROM k p WHERE p.cust = k.cust AND p.day < k.day AND p.kind IN ('stop','unknown') ORDER BY p.day DESC, p.id DESC LIMIT 1) s(id, day, kind) ON true""".replace("SELECT id, CASE WHEN s.kind", "SELECT k.id AS id, CASE WHEN s.kind"))
def pit_win_streak(spark, sf):
    kind = F.when(F.col("status") == "F", "win").when(F.col("status") == "O", "stop").when(F.col("prio") == "5-LOW", "unknown").otherwise("skip")
    return pit.streak(_orders(spark, sf), "cust", "day", "id", kind).select("id", "streak")


@query(O + " SELECT c_custkey AS cust, count(o.id)::BIGINT AS n_prior, sum(cents)::BIGINT AS sum_prior, date_diff('day', max(day), DATE '2000-01-01')::INT AS days_since FROM customer LEFT JOIN o ON o.cust = c_custkey AND day < DATE '2000-01-01' GROUP BY 1")
def pit_current_rows(spark, sf):
    o, c = _orders(spark, sf), table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "cust")
    rows = pit.career(pit.current_rows(o, c, "cust", "day", "id", "2000-01-01"), "cust", "day", n_prior=F.count("id"), sum_prior=F.sum("cents"))
    return rows.withColumn("days_since", pit.days_since_last("cust", "day")).where("is_target").select("cust", "n_prior", "sum_prior", "days_since")


@query(O + " SELECT id, coalesce((SELECT min(day) FROM o p WHERE p.cust = o.cust AND p.status = 'P') < least(day, DATE '2001-01-01'), false) AS unresolved FROM o")
def pit_unresolved_prior(spark, sf):
    first = F.min(F.when(F.col("status") == "P", F.col("day"))).over(Window.partitionBy("cust"))
    return _orders(spark, sf).select("id", F.coalesce(first < F.least("day", F.lit("2001-01-01").cast("date")), F.lit(False)).alias("unresolved"))


@query(E + " SELECT usr, id, us FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY us DESC, id DESC) AS rn FROM e) WHERE rn <= 5")
def recent_k(spark, sf):
    return pit.recent(_events(spark, sf), "usr", [F.desc("us"), F.desc("id")], 5).select("usr", "id", "us")


# --- as-of ---------------------------------------------------------------------------------------------------


@query(E + " SELECT p.id, s.us AS signup_us, s.id AS signup_id FROM e p LEFT JOIN LATERAL (SELECT us, id FROM e s WHERE s.usr = p.usr AND s.kind = 'signup' AND s.us < p.us ORDER BY us DESC, id DESC LIMIT 1) s ON true WHERE p.kind = 'purchase'")
def asof_last_event_before(spark, sf):
    e = _events(spark, sf).select("id", "us", "usr", "kind")
    s = e.where("kind = 'signup'").select("usr", F.col("us").alias("signup_us"), F.col("id").alias("signup_id"))
    out = asof.latest_before(e.where("kind = 'purchase'"), s, ["usr"], "us", "signup_us", ["signup_id"])
    return out.select("id", F.col("signup_us_matched").alias("signup_us"), "signup_id")


_RANK_SQL = """
WITH facts AS (SELECT f.id AS fight_id, s.fighter_id, e.circuit_id, f.weight_class, e.event_date AS day
  FROM fights f JOIN fight_events e ON e.id = f.event_id, LATERAL (VALUES (fighter_a_id), (fighter_b_id)) s(fighter_id) WHERE f.weight_class IS NOT NULL),
lists AS (SELECT DISTINCT circuit_id, weight_class, source, snapshot_date FROM rankings),
m AS (SELECT DISTINCT circuit_id, weight_class, day FROM facts),
c AS (SELECT m.*, l.source, max(l.snapshot_date) AS snap FROM m JOIN lists l USING (circuit_id, weight_class) WHERE l.snapshot_date < m.day GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY circuit_id, weight_class, day ORDER BY (day - snap > 21), CASE source WHEN 'weekly_list' THEN 0 ELSE 1 END) AS rn FROM c),
r AS (SELECT circuit_id, weight_class, source, snapshot_date, fighter_id, min(rank) AS rank FROM rankings WHERE fighter_id IS NOT NULL GROUP BY ALL)
SELECT facts.fight_id, facts.fighter_id, b.source, b.snap AS snapshot_at, CASE WHEN b.snap IS NOT NULL AND facts.day - b.snap <= 21 THEN r.rank END::BIGINT AS value,
  CASE WHEN b.snap IS NULL THEN 'no_snapshot' WHEN facts.day - b.snap > 21 THEN 'stale' WHEN r.rank IS NULL THEN 'unranked' ELSE 'ranked' END AS status
FROM facts LEFT JOIN b ON b.rn = 1 AND b.circuit_id = facts.circuit_id AND b.weight_class = facts.weight_class AND b.day = facts.day
LEFT JOIN r ON r.circuit_id = facts.circuit_id AND r.weight_class = facts.weight_class AND r.source = b.source AND r.snapshot_date = b.snap AND r.fighter_id = facts.fighter_id"""


@query(_RANK_SQL)
def asof_priority_fresh_cap(spark, sf):
    f = sides.explode_sides(table(spark, sf, "fights", "id", "event_id", "fighter_a_id", "fighter_b_id", "weight_class").where("weight_class is not null"), "fighter_a_id", "fighter_b_id", entity="fighter_id")
    e = table(spark, sf, "fight_events", "id", "circuit_id", "event_date").select(F.col("id").alias("event_id"), "circuit_id", F.col("event_date").alias("day"))
    facts = f.join(e, "event_id").select(F.col("id").alias("fight_id"), "fighter_id", "circuit_id", "weight_class", "day")
    r = table(spark, sf, "rankings", "circuit_id", "source", "snapshot_date", "weight_class", "fighter_id", "rank").withColumn("rank", F.col("rank").cast("long"))
    out = asof.snapshot_status(facts, r, ["circuit_id", "weight_class"], "day", "snapshot_date", "source", {"weekly_list": 0, "panel_list": 1}, "fighter_id", "rank", 21)
    return out.select("fight_id", "fighter_id", "source", "snapshot_at", "value", "status")


@query(O + " SELECT cust, id, cents FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY day DESC, id DESC) AS rn FROM o) WHERE rn = 1")
def latest_per_key(spark, sf):
    return asof.latest_per_key(_orders(spark, sf), ["cust"], [F.col("day"), F.col("id")], ["id", "cents"]).select("cust", "id", "cents")


@query(O + " SELECT c_custkey AS cust, (SELECT id FROM o WHERE o.cust = c_custkey AND status = 'F' AND cents > 10000000 ORDER BY day DESC, id DESC LIMIT 1) AS id FROM customer")
def top1_filtered(spark, sf):
    best = asof.latest_per_key(_orders(spark, sf).where("status = 'F' and cents > 10000000"), ["cust"], [F.col("day"), F.col("id")], ["id"]).select("cust", F.col("id"))
    return table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "cust").join(best, "cust", "left")


@query(O + " SELECT cust, arg_max(cents, (day, id)) FILTER (WHERE status <> 'F') AS last_open, arg_max(prio, (day, id)) FILTER (WHERE prio <> '5-LOW') AS last_prio FROM o GROUP BY 1")
def last_non_null_merge(spark, sf):
    o = _orders(spark, sf).select("cust", "day", "id", F.when(F.col("status") != "F", F.col("cents")).alias("last_open"), F.when(F.col("prio") != "5-LOW", F.col("prio")).alias("last_prio"))
    return asof.last_non_null(o, ["cust"], [F.col("day"), F.col("id")], ["last_open", "last_prio"])


# --- filters, projections, joins -----------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%green%' OR p_name ILIKE 'a\\_%' ESCAPE '\\'")
def ilike_escaped(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_name").where("p_name ilike '%green%' or p_name ilike 'a!_%' escape '!'")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' - 1 AND DATE '1996-01-01' + 30 AND o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def filtered_orders(spark, sf):
    """Date range, null-safe inequality and semi join."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey").withColumn("day", F.to_date("o_orderdate"))
    d = F.lit("1996-01-01").cast("date")
    o = o.where(F.col("day").between(F.date_sub(d, 1), F.date_add(d, 30)) & ~F.col("o_orderpriority").eqNullSafe("1-URGENT"))
    return o.join(table(spark, sf, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "day")


@query("SELECT entity, count(*)::BIGINT AS n, sum(CASE WHEN side = 'a' THEN 1 ELSE 0 END)::BIGINT AS n_a FROM (SELECT l_partkey AS entity, 'a' AS side FROM lineitem UNION ALL SELECT l_suppkey, 'b' FROM lineitem) GROUP BY 1")
def sides_union_count(spark, sf):
    s = sides.explode_sides(table(spark, sf, "lineitem", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")
    return s.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "a").alias("n_a"))


@query("SELECT s_suppkey AS entity, (SELECT count(*) FROM lineitem WHERE l_partkey = s_suppkey OR l_suppkey = s_suppkey)::BIGINT AS n FROM supplier")
def or_join_rewritten(spark, sf):
    """A join on x = a OR x = b, as explode and equi join; a row that has the entity on both sides counts once."""
    line = table(spark, sf, "lineitem", "l_partkey", "l_suppkey")
    s = line.withColumn("entity", F.explode(F.array_distinct(F.array("l_partkey", "l_suppkey")))).groupBy("entity").agg(F.count("*").alias("n"))
    return table(spark, sf, "supplier", "s_suppkey").withColumnRenamed("s_suppkey", "entity").join(s, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def neutral_pair(spark, sf):
    lo, hi = sides.pair_key("l_partkey", "l_suppkey")
    return table(spark, sf, "lineitem", "l_partkey", "l_suppkey").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"))


@query("SELECT f.id AS fight_id, s.fighter_id, CASE WHEN lower(trim(outcome)) = 'win' THEN CASE WHEN winner_id IS NULL THEN 'unknown' WHEN winner_id = s.fighter_id THEN 'win' ELSE 'loss' END WHEN lower(trim(outcome)) = 'draw' THEN 'draw' WHEN lower(trim(outcome)) IN ('no_contest','no contest','nc') THEN 'nc' ELSE 'unknown' END AS result FROM fights f, LATERAL (VALUES (fighter_a_id), (fighter_b_id)) s(fighter_id)")
def perspective_results(spark, sf):
    f = sides.explode_sides(table(spark, sf, "fights", "id", "fighter_a_id", "fighter_b_id", "winner_id", "outcome"), "fighter_a_id", "fighter_b_id", entity="fighter_id")
    return f.select(F.col("id").alias("fight_id"), "fighter_id", sides.perspective(F.col("fighter_id"), F.col("winner_id"), F.col("outcome")).alias("result"))


@query("SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE o.o_orderstatus = 'P'")
def inner_star_join(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'")
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT f.id, a.name AS a, b.name AS b, r.name AS red, w.name AS winner FROM fights f LEFT JOIN fighters a ON a.id = fighter_a_id LEFT JOIN fighters b ON b.id = fighter_b_id LEFT JOIN fighters r ON r.id = red_fighter_id LEFT JOIN fighters w ON w.id = winner_id")
def role_joins(spark, sf):
    """One dimension in four roles."""
    out, p = table(spark, sf, "fights", "id", "fighter_a_id", "fighter_b_id", "red_fighter_id", "winner_id"), table(spark, sf, "fighters", "id", "name")
    for role, key in (("a", "fighter_a_id"), ("b", "fighter_b_id"), ("red", "red_fighter_id"), ("winner", "winner_id")):
        out = out.join(p.select(F.col("id").alias(key), F.col("name").alias(role)), key, "left")
    return out.select("id", "a", "b", "red", "winner")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, sf):
    return table(spark, sf, "customer", "c_custkey").join(table(spark, sf, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark, sf):
    return table(spark, sf, "customer", "c_custkey").join(table(spark, sf, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def left_coverage(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer", "c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT a.snapshot_date, a.circuit_id, a.weight_class, count(*)::BIGINT AS both_lists, sum(CASE WHEN a.rank = b.rank THEN 1 ELSE 0 END)::BIGINT AS agree FROM (SELECT DISTINCT circuit_id, weight_class, snapshot_date, fighter_id, rank FROM rankings WHERE source = 'weekly_list' AND fighter_id IS NOT NULL) a JOIN (SELECT DISTINCT circuit_id, weight_class, snapshot_date, fighter_id, rank FROM rankings WHERE source = 'panel_list' AND fighter_id IS NOT NULL) b USING (circuit_id, weight_class, snapshot_date, fighter_id) GROUP BY ALL")
def self_join_agreement(spark, sf):
    r = table(spark, sf, "rankings", "circuit_id", "weight_class", "snapshot_date", "fighter_id", "rank", "source").where("fighter_id is not null")
    keys = ["circuit_id", "weight_class", "snapshot_date", "fighter_id"]
    a, b = (r.where(F.col("source") == s).select(*keys, F.col("rank").alias(n)).distinct() for s, n in (("weekly_list", "ra"), ("panel_list", "rb")))
    return a.join(b, keys).groupBy("snapshot_date", "circuit_id", "weight_class").agg(F.count("*").alias("both_lists"), F.count_if(F.col("ra") == F.col("rb")).alias("agree"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*)::BIGINT AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_agreement(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    label = lambda c: F.when(F.grouping(c) == 1, "all").otherwise(F.coalesce(c, F.lit("all")))
    out = li.rollup("l_returnflag", "l_linestatus").agg(label("l_returnflag").alias("flag"), label("l_linestatus").alias("status"), F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return out.select("flag", "status", "n", "cents")


@query("SELECT r_name, k.kind FROM region, (VALUES ('division'), ('p4p')) k(kind)")
def literal_cross(spark, sf):
    """A few literal rows for each row: an array exploded, no join."""
    return table(spark, sf, "region", "r_name").withColumn("kind", F.explode(F.array(F.lit("division"), F.lit("p4p"))))


@query("SELECT p.c_custkey AS entity, p.day, (SELECT count(*) FROM orders WHERE o_custkey = p.c_custkey AND o_orderdate::DATE < p.day)::BIGINT AS n FROM (SELECT c_custkey, DATE '1996-01-01' + (c_custkey % 1000)::INT AS day FROM customer) p")
def parameter_relation_counts(spark, sf):
    """(key, date) parameters joined to how many facts each key had before its date."""
    p = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("entity"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("day"))
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"))
    return p.join(o, "entity", "left").groupBy("entity", "day").agg(F.count_if(F.col("d") < F.col("day")).alias("n"))


@query("SELECT id AS fight_id, coalesce(n, 0)::BIGINT AS n FROM fights LEFT JOIN (SELECT fight_id, count(DISTINCT fighter_id) AS n FROM fight_features GROUP BY 1) x ON x.fight_id = fights.id WHERE status = 'completed' AND coalesce(n, 0) <> 2")
def incomplete_groups(spark, sf):
    n = table(spark, sf, "fight_features", "fight_id", "fighter_id").groupBy("fight_id").agg(F.countDistinct("fighter_id").alias("n"))
    f = table(spark, sf, "fights", "id", "status").where("status = 'completed'").select(F.col("id").alias("fight_id"))
    return f.join(n, "fight_id", "left").select("fight_id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 2")


# --- aggregation ---------------------------------------------------------------------------------------------


@query(O + " SELECT cust, count(*) FILTER (WHERE status = 'F')::BIGINT AS wins, count(*) FILTER (WHERE status = 'O')::BIGINT AS losses, count(*) FILTER (WHERE status = 'P')::BIGINT AS others, min(day) AS first_day, max(day) AS last_day FROM o GROUP BY 1")
def record_filter_pivot(spark, sf):
    s = F.col("status")
    return _orders(spark, sf).groupBy("cust").agg(F.count_if(s == "F").alias("wins"), F.count_if(s == "O").alias("losses"), F.count_if(s == "P").alias("others"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(O + " SELECT count(DISTINCT cust) FILTER (WHERE day >= DATE '2000-01-01')::BIGINT AS custs_since, count(DISTINCT cust)::BIGINT AS custs, count(*)::BIGINT AS n, count(*) FILTER (WHERE status = 'P')::BIGINT AS pending FROM o")
def global_counts(spark, sf):
    """Many counts in one pass; the distinct ones are exact."""
    since = F.when(F.col("day") >= F.lit("2000-01-01").cast("date"), F.col("cust"))
    return _orders(spark, sf).agg(F.countDistinct(since).alias("custs_since"), F.countDistinct("cust").alias("custs"), F.count("*").alias("n"), F.count_if(F.col("status") == "P").alias("pending"))


@query(O + " SELECT CASE WHEN grouping(split) = 0 THEN split END AS split, CASE WHEN grouping(y) = 0 THEN y END AS y, n, fin, round(100.0 * fin / n, 1)::DOUBLE AS pct FROM (SELECT split, y, count(*)::BIGINT AS n, count(*) FILTER (WHERE status = 'F')::BIGINT AS fin, grouping(split) AS gs, grouping(y) AS gy FROM (SELECT *, CASE WHEN day < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, year(day)::INT AS y FROM o) GROUP BY GROUPING SETS ((split), (y)))".replace("CASE WHEN grouping(split) = 0 THEN split END AS split, CASE WHEN grouping(y) = 0 THEN y END AS y", "split, y"))
def coverage_report(spark, sf):
    o = _orders(spark, sf).withColumns({"split": F.when(F.col("day") < F.lit("1999-01-01").cast("date"), "train").otherwise("test"), "y": F.year("day")})
    fin, n = F.count_if(F.col("status") == "F"), F.count("*")
    return o.groupingSets([["split"], ["y"]], "split", "y").agg(n.alias("n"), fin.alias("fin")).withColumn("pct", aggregate.share(F.col("fin"), F.col("n")))


@query("SELECT l_suppkey, round(CASE WHEN sum(q) > 0 THEN sum(c)::DOUBLE / sum(q) END, 6) AS price FROM (SELECT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice * 100)::BIGINT END AS c, CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN l_quantity::BIGINT END AS q FROM lineitem) WHERE c IS NOT NULL AND q IS NOT NULL GROUP BY 1")
def ratio_of_sums(spark, sf):
    li = table(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    c = F.when(F.col("l_returnflag") != "R", F.round(F.col("l_extendedprice") * 100).cast("long"))
    q = F.when((F.col("l_returnflag") != "R") & (F.col("l_linestatus") == "F"), F.col("l_quantity").cast("long"))
    num, den = pit.ratio_of_sums(c, q)
    out = li.groupBy("l_suppkey").agg(num.alias("num"), den.alias("den")).where("den is not null")
    return out.select("l_suppkey", F.round(pit.safe_ratio(F.col("num").cast("double"), F.col("den").cast("double")), 6).alias("price"))


@query(E + " SELECT usr, round(avg(p), 9) AS probability, count(*)::BIGINT AS quotes, max(us) AS freshest FROM (SELECT usr, kind, us, 1.0 / (1 + cents) AS p, row_number() OVER (PARTITION BY usr, kind ORDER BY us DESC, id DESC) AS rn FROM e WHERE cents >= 0) WHERE rn = 1 GROUP BY 1")
def consensus_latest_mean(spark, sf):
    e = _events(spark, sf).where("cents >= 0")
    out = aggregate.consensus(e, ["usr"], ["kind"], "us", "id", 1.0 / (1 + F.col("cents")))
    return out.select("usr", F.round("probability", 9).alias("probability"), "quotes", "freshest")


@query("WITH r AS (SELECT * FROM rankings WHERE fighter_id IS NOT NULL AND ranking_type = 'division' AND source = 'panel_list'), bad AS (SELECT DISTINCT snapshot_date FROM (SELECT circuit_id, snapshot_date, weight_class, name_raw, count(*) AS n FROM r GROUP BY ALL) WHERE n > 1) SELECT snapshot_date, count(*)::BIGINT AS n FROM r WHERE snapshot_date NOT IN (SELECT snapshot_date FROM bad) GROUP BY 1")
def dup_snapshot_drop(spark, sf):
    r = table(spark, sf, "rankings", "circuit_id", "snapshot_date", "weight_class", "name_raw", "fighter_id", "ranking_type", "source").where("fighter_id is not null and ranking_type = 'division' and source = 'panel_list'")
    return aggregate.drop_repeated_groups(r, ["circuit_id", "snapshot_date", "weight_class", "name_raw"], "snapshot_date").groupBy("snapshot_date").agg(F.count("*").alias("n"))


@query(E + " SELECT kind, round(quantile_cont(cents, 0.5), 6)::DOUBLE AS median, round(quantile_cont(cents, 0.95), 6)::DOUBLE AS p95, min(cents) AS low, max(cents) AS high FROM e GROUP BY 1")
def median_p95(spark, sf):
    return _events(spark, sf).groupBy("kind").agg(F.round(F.percentile("cents", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("cents", F.lit(0.95)), 6).alias("p95"), F.min("cents").alias("low"), F.max("cents").alias("high"))


_LES = (100.0, 1000.0, 5000.0, 10000.0, 50000.0, float("inf"))


@query(E + """, b AS (SELECT kind, x.le, count(*) FILTER (WHERE cents <= x.le)::BIGINT AS cum FROM e, (VALUES (100.0::DOUBLE),(1000),(5000),(10000),(50000),('inf'::DOUBLE)) x(le) GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS before, max(cum) OVER (PARTITION BY kind) * 0.9 AS rk FROM b WINDOW w AS (PARTITION BY kind ORDER BY le)),
h AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY le) AS rn FROM l WHERE cum >= rk AND rk > 0)
SELECT kind, round(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (rk - before) / (cum - before) END, 6) AS quantile FROM h WHERE rn = 1""")
def hist_quantile(spark, sf):
    e = _events(spark, sf)
    counts = e.groupBy("kind").agg(*(F.count_if(F.col("cents") <= le).alias(f"c{i}") for i, le in enumerate(_LES)))
    b = counts.select("kind", F.explode(F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"c{i}").alias("cum")) for i, le in enumerate(_LES)))).alias("x")).select("kind", "x.le", "x.cum")
    return aggregate.histogram_quantile(b, ["kind"], "le", "cum", 0.9).select("kind", F.round("quantile", 6).alias("quantile"))


@query("SELECT bin::INT AS bin, count(*)::BIGINT AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS mean_y FROM (SELECT l_discount AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, ntile(10) OVER (ORDER BY l_discount, l_orderkey * 10 + l_linenumber) AS bin FROM lineitem) GROUP BY 1")
def calibration_ntile(spark, sf):
    li = table(spark, sf, "lineitem", "l_discount", "l_returnflag", "l_orderkey", "l_linenumber").select(F.col("l_discount").alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return aggregate.equal_count_bins(li, F.col("p"), "tie", 10, "y", "p").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("mean_y", 9).alias("mean_y"))


@query("WITH h AS (SELECT sha256(concat_ws('|', n_nationkey::VARCHAR, coalesce(n_name, '~'), n_regionkey::VARCHAR)) AS h FROM nation), p AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS ph, count(*) AS n FROM h GROUP BY 1) SELECT sha256('1' || chr(10) || string_agg(ph, chr(10) ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS rows FROM p")
def content_fingerprint(spark, sf):
    return aggregate.fingerprint(table(spark, sf, "nation"), [F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")])


@query("WITH h AS (SELECT sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, coalesce(o_orderstatus, '~'))) AS h FROM orders), p AS (SELECT substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS ph, count(*) AS n FROM h GROUP BY 1) SELECT sha256('1' || chr(10) || string_agg(ph, chr(10) ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS rows FROM p")
def orders_fingerprint(spark, sf):
    return aggregate.fingerprint(table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus"), [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")])


@query("SELECT o_orderkey AS id, 'total' AS \"column\", s AS part_sum, t AS total FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS t, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) WHERE s <> t")
def sum_reconcile(spark, sf):
    parts = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice").select(F.col("l_orderkey").alias("id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("total"))
    totals = _orders(spark, sf).select("id", F.col("cents").alias("total"))
    return aggregate.reconcile_sums(parts, totals, ["id"], ["total"], null_as_zero=True)


@query("SELECT l_orderkey, l_linenumber, measure, value FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR measure IN (quantity, discount, tax))")
def unpivot_measures(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "measure", "value").where("value is not null")


@query("SELECT year(ts)::INT * 100 + month(ts)::INT AS ym, event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def grouping_year(spark, sf):
    e = table(spark, sf, "events", "ts", "event_type")
    return e.groupBy((F.year("ts") * 100 + F.month("ts")).alias("ym"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query(E + " SELECT kind, count(*)::BIGINT AS n, round(count(*) * 1.0 / (SELECT count(*) FROM e), 9)::DOUBLE AS prior FROM e GROUP BY 1")
def class_priors(spark, sf):
    e = _events(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))
    total = e.agg(F.sum("n").alias("t"))
    return e.select("kind", "n", F.round(F.col("n") / total.scalar(), 9).alias("prior"))


@query(E + ", x AS (SELECT usr, max(CASE WHEN kind = 'view' THEN 1 ELSE 0 END) AS v, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS p FROM e GROUP BY 1) SELECT count(*) FILTER (WHERE v = 1 AND p = 1)::BIGINT AS both_kinds, count(*) FILTER (WHERE v = 1 AND p = 0)::BIGINT AS only_view, count(*) FILTER (WHERE v = 0 AND p = 1)::BIGINT AS only_purchase FROM x")
def gap_classification(spark, sf):
    x = _events(spark, sf).groupBy("usr").agg(F.max((F.col("kind") == "view").cast("int")).alias("v"), F.max((F.col("kind") == "purchase").cast("int")).alias("p"))
    n = lambda a, b, name: F.count_if((F.col("v") == a) & (F.col("p") == b)).alias(name)
    return x.agg(n(1, 1, "both_kinds"), n(1, 0, "only_view"), n(0, 1, "only_purchase"))


# --- merges --------------------------------------------------------------------------------------------------

_OLD = "old AS (SELECT id, prio AS r, CASE WHEN cents % 5 = 0 THEN NULL ELSE status END AS f, cents % 3 = 0 AS s, status FROM o WHERE day < DATE '2000-06-01'), new AS (SELECT id, CASE WHEN cents % 7 = 0 THEN NULL ELSE prio END AS r, CASE WHEN cents % 2 = 0 THEN NULL ELSE status END AS f, CASE WHEN cents % 11 = 0 THEN true WHEN cents % 13 = 0 THEN NULL ELSE false END AS s FROM o WHERE day >= DATE '1996-01-01')"
_MERGED = O + ", " + _OLD + """, j AS (SELECT coalesce(old.id, new.id) AS id, old.id IS NULL AS ins, new.id IS NULL AS kept, old.status, old.r AS ro, old.f AS fo, old.s AS so, new.r AS rn, new.f AS fn, new.s AS sn FROM old FULL JOIN new ON old.id = new.id),
m AS (SELECT *, rn AS rm, coalesce(fn, fo) AS fm, CASE WHEN so OR sn THEN true ELSE coalesce(sn, so) END AS sm FROM j),
a AS (SELECT *, CASE WHEN ins THEN 'inserted' WHEN kept THEN 'kept' WHEN fo IS DISTINCT FROM 'P' AND fo IS NOT NULL AND (rm IS DISTINCT FROM ro OR fm IS DISTINCT FROM fo OR sm IS DISTINCT FROM so) THEN 'updated' ELSE 'unchanged' END AS action FROM m)"""


def _versions(spark, sf):
    o = _orders(spark, sf)
    c = F.col("cents")
    old = o.where("day < '2000-06-01'").select("id", F.col("prio").alias("r"), F.when(c % 5 != 0, F.col("status")).alias("f"), (c % 3 == 0).alias("s"))
    new = o.where("day >= '1996-01-01'").select("id", F.when(c % 7 != 0, F.col("prio")).alias("r"), F.when(c % 2 != 0, F.col("status")).alias("f"), F.when(c % 11 == 0, True).when(c % 13 == 0, None).otherwise(False).alias("s"))
    return old, new


def _merged(spark, sf):
    old, new = _versions(spark, sf)
    merge.reject_duplicates(new, ["id"])
    return merge.policy_merge(old, new, ["id"], replace=["r"], fill=["f"], sticky_true=["s"], only_if=F.col("held.f") != "P")


@query(_MERGED + " SELECT id, CASE action WHEN 'inserted' THEN rn WHEN 'updated' THEN rm ELSE ro END AS r, CASE action WHEN 'inserted' THEN fn WHEN 'updated' THEN fm ELSE fo END AS f, CASE action WHEN 'inserted' THEN sn WHEN 'updated' THEN sm ELSE so END AS s, action FROM a")
def policy_merge(spark, sf):
    return _merged(spark, sf)


@query(_MERGED + " SELECT action, count(*)::BIGINT AS n FROM a WHERE action <> 'kept' GROUP BY 1")
def policy_merge_counts(spark, sf):
    return merge.merge_counts(_merged(spark, sf))


@query(O + ", " + _OLD + " SELECT id, r FROM old UNION ALL SELECT id, r FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_missing(spark, sf):
    old, new = _versions(spark, sf)
    return merge.insert_missing(old.select("id", "r"), new.select("id", "r").union(new.select("id", "r")), ["id"], [F.col("r")])


@query(O + " SELECT id, prio, cents FROM o WHERE prio <> '1-URGENT' UNION ALL SELECT id + 1000000000, '1-URGENT', cents FROM o WHERE prio = '1-URGENT'")
def refresh_partition(spark, sf):
    o = _orders(spark, sf).select("id", "prio", "cents")
    return merge.refresh_partition(o, o.where("prio = '1-URGENT'").withColumn("id", F.col("id") + 1_000_000_000), "prio")


@query(O + ", l AS (SELECT cust, id FROM o WHERE cents % 4 <> 0 AND cust % 10 <> 3) SELECT id, CASE WHEN cust IN (SELECT cust FROM l) AND id NOT IN (SELECT id FROM l) AND st = 'scheduled' THEN 'cancelled' ELSE st END AS status, CASE WHEN cust IN (SELECT cust FROM l) AND id NOT IN (SELECT id FROM l) AND st = 'completed' THEN 'missing_completed' END AS anomaly FROM (SELECT *, CASE WHEN status = 'F' THEN 'completed' ELSE 'scheduled' END AS st FROM o)")
def reconcile_cancelled(spark, sf):
    o = _orders(spark, sf)
    held = o.select("id", "cust", F.when(F.col("status") == "F", "completed").otherwise("scheduled").alias("status"))
    return merge.reconcile(held, o.where("cents % 4 <> 0 and cust % 10 <> 3").select("cust", "id"), "cust", "id").select("id", "status", "anomaly")


@query(O + ", p AS (SELECT id, status, prio FROM o WHERE cents % 3 <> 0), s AS (SELECT id, CASE WHEN cents % 5 = 0 THEN 'X' ELSE status END AS status, CASE WHEN cents % 7 = 0 THEN NULL ELSE prio END AS prio FROM o WHERE cents % 4 <> 0) SELECT coalesce(p.id, s.id) AS id, CASE WHEN p.id IS NOT NULL THEN p.status ELSE s.status END AS status, CASE WHEN p.id IS NOT NULL THEN p.prio ELSE s.prio END AS prio, CASE WHEN p.id IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source, CASE WHEN p.status <> s.status THEN 'status' ELSE '' END AS disagreements FROM p FULL JOIN s ON p.id = s.id")
def precedence_merge(spark, sf):
    o = _orders(spark, sf)
    c = F.col("cents")
    p = o.where(c % 3 != 0).select("id", "status", "prio")
    s = o.where(c % 4 != 0).select("id", F.when(c % 5 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(c % 7 != 0, F.col("prio")).alias("prio"))
    return merge.precedence_merge(p, s, ["id"], ["status", "prio"]).withColumn("disagreements", F.array_join("disagreements", ","))


@query(O + ", h AS (SELECT id, cust FROM o), l AS (SELECT cust, id FROM o WHERE cents % 2 = 0 AND cust % 5 <> 0) SELECT id, cust FROM h WHERE NOT (cust IN (SELECT cust FROM l) AND id NOT IN (SELECT id FROM l))")
def delete_missing(spark, sf):
    o = _orders(spark, sf)
    return merge.delete_missing(o.select("id", "cust"), o.where("cents % 2 = 0 and cust % 5 <> 0").select("id", "cust"), ["id"], ["cust"])


_CHECKS = {
    "neutral_order": "fighter_a_id < fighter_b_id",
    "winner_is_a_side": "winner_id IN (fighter_a_id, fighter_b_id)",
    "win_has_winner": "NOT (lower(trim(outcome)) = 'win' AND winner_id IS NULL)",
    "completed_has_result": "status <> 'completed' OR outcome IS NOT NULL",
    "unfought_has_none": "status = 'completed' OR outcome IS NULL",
    "round_range": "finish_round BETWEEN 1 AND 5",
    "time_range": "finish_time_sec BETWEEN 0 AND 300",
    "id_form": "ufcstats_id RLIKE '^[0-9a-f]{16}$'",
}


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS \"constraint\" FROM fights WHERE NOT coalesce({s.replace('ufcstats_id RLIKE ', 'regexp_full_match(ufcstats_id, ') + (')' if 'RLIKE' in s else '')}, true)" for n, s in _CHECKS.items()))
def row_constraint_violations(spark, sf):
    return merge.violations(table(spark, sf, "fights"), ["id"], _CHECKS)


@query("SELECT ufcstats_id, count(*)::BIGINT AS n FROM fights WHERE ufcstats_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def unique_key_violations(spark, sf):
    return table(spark, sf, "fights", "ufcstats_id").where("ufcstats_id is not null").groupBy("ufcstats_id").agg(F.count("*").alias("n")).where("n > 1")


# --- matching ------------------------------------------------------------------------------------------------

_FACTS = "f AS (SELECT id AS fact_id, cust % 200 AS pair, day FROM o WHERE status = 'F'), r AS (SELECT id AS row_id, cust % 200 AS pair, day + (cents % 3)::INT - 1 AS day FROM o WHERE status = 'O')"


@query(O + ", " + _FACTS + """, j AS (SELECT r.row_id, count(*) FILTER (WHERE f.day = r.day) AS n0, count(*) FILTER (WHERE abs(f.day - r.day) <= 1) AS n1, min(fact_id) FILTER (WHERE f.day = r.day) AS f0, min(fact_id) FILTER (WHERE abs(f.day - r.day) <= 1) AS f1 FROM r LEFT JOIN f USING (pair) GROUP BY 1),
s AS (SELECT row_id, CASE WHEN n0 = 1 THEN 'exact' WHEN n0 > 1 THEN 'ambiguous' WHEN n1 = 1 THEN 'near' WHEN n1 > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n0 = 1 THEN f0 WHEN n0 = 0 AND n1 = 1 THEN f1 END AS fact_id FROM j)
SELECT row_id, fact_id, CASE WHEN fact_id IS NOT NULL AND row_number() OVER (PARTITION BY fact_id ORDER BY row_id) > 1 THEN 'duplicate' ELSE status END AS status FROM s""")
def tiered_match_exact_else_1day(spark, sf):
    o = _orders(spark, sf).withColumn("pair", F.col("cust") % 200)
    facts = o.where("status = 'F'").select(F.col("id").alias("fact_id"), "pair", "day")
    rows = o.where("status = 'O'").select(F.col("id").alias("row_id"), "pair", F.date_add("day", (F.col("cents") % 3).cast("int") - 1).alias("day")).withColumn("ord", F.col("row_id"))
    return matching.tiered_pair_match(rows, facts, "row_id", "fact_id", "pair", "day", "ord")


@query(O + """, f AS (SELECT id AS fact_id, CASE WHEN cents % 10 = 0 THEN 'n' || (id % 5000) END AS nat, cust % 100 AS pair, day FROM o WHERE status = 'F'), r AS (SELECT id AS row_id, CASE WHEN cents % 4 = 0 THEN 'n' || (id % 5000) END AS nat, cust % 100 AS pair, day FROM o WHERE status <> 'F'),
a AS (SELECT nat, min(fact_id) AS fa FROM f WHERE nat IS NOT NULL GROUP BY 1),
b AS (SELECT row_id, min((CASE f.day - r.day WHEN 0 THEN 1 WHEN -1 THEN 2 ELSE 3 END, fact_id)) AS m FROM r JOIN f USING (pair) WHERE abs(f.day - r.day) <= 1 GROUP BY 1)
SELECT r.row_id, coalesce(fa, m[2]) AS fact_id, CASE WHEN fa IS NOT NULL THEN 0 ELSE m[1] END::INT AS tier FROM r LEFT JOIN a USING (nat) LEFT JOIN b USING (row_id)""".replace("m[2]", "struct_extract_at(m, 2)").replace("m[1]", "struct_extract_at(m, 1)"))
def two_tier_match(spark, sf):
    o = _orders(spark, sf)
    nat = lambda m: F.when(F.col("cents") % m == 0, F.concat(F.lit("n"), F.col("id") % 5000))
    facts = o.where("status = 'F'").select(F.col("id").alias("fact_id"), nat(10).alias("nat"), (F.col("cust") % 100).alias("pair"), "day")
    rows = o.where("status <> 'F'").select(F.col("id").alias("row_id"), nat(4).alias("nat"), (F.col("cust") % 100).alias("pair"), "day")
    return matching.two_tier_match(rows, facts, "row_id", "fact_id", "nat", "pair", "day")


@query("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), x AS (SELECT w FROM n WHERE w <> '')
SELECT a.w AS a, b.w AS b FROM x a JOIN x b ON a.w < b.w WHERE damerau_levenshtein(a.w, b.w) = 1""")
def edit1_pairs(spark, sf):
    """Words of part names one edit apart; candidates share the word with a letter left out."""
    words = table(spark, sf, "part", "p_name").select(F.explode(F.slice(F.split("p_name", " "), 1, 2)).alias("w")).where("w <> ''").distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substr("w", F.lit(1), i - 1), F.substr("w", i + 1)))
    k = words.withColumn("k", F.explode(F.array_distinct(F.concat(F.array("w"), cuts))))
    pairs = k.select(F.col("w").alias("a"), "k").join(k.select(F.col("w").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    return pairs.where(matching.within_one_edit(F.col("a"), F.col("b")))


@query()
def fuzzy_name_pairs(spark, sf):
    return matching.duplicate_pairs(table(spark, sf, "fighters", "id", "name"), "id", "name")


@query()
def name_resolution_status(spark, sf):
    """Both corners of typed bout rows: row_id, corner, entity, status."""
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), F.col(f"{c}_name").alias("name")) for c in ("red", "blue"))))
    md = table(spark, sf, "mdabbert_rows", "row_id", "red_name", "blue_name", "bout_date", "weight_class").select("row_id", "bout_date", "weight_class", corner.alias("c"))
    md = md.select(F.struct("row_id", "c.corner").alias("row_id"), F.lit("mdabbert").alias("source"), "c.name", F.col("bout_date").alias("day"), "weight_class")
    people = table(spark, sf, "fighters", "id", "name", "ufcstats_id")
    al = table(spark, sf, "aliases", "source", "alias", "ufcstats_id").join(people.select("ufcstats_id", F.col("id").alias("entity")), "ufcstats_id")
    e = table(spark, sf, "fight_events", "id", "event_date").select(F.col("id").alias("event_id"), "event_date")
    act = sides.explode_sides(table(spark, sf, "fights", "event_id", "weight_class", "fighter_a_id", "fighter_b_id"), "fighter_a_id", "fighter_b_id").join(e, "event_id").groupBy("entity", "weight_class").agg(F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))
    done = matching.resolve_names(md, people.select(F.col("id").alias("entity"), "name"), al, act)
    return done.select("row_id.row_id", "row_id.corner", "entity", "status")


# --- sort, limit, paging, sets -------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, (lower(p_name) = 'blue') AS exact, starts_with(lower(p_name), 'b') AS prefix, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey)::BIGINT AS n_lines, total FROM (SELECT *, (SELECT count(*) FROM part WHERE contains(lower(p_name), 'b'))::BIGINT AS total FROM part WHERE contains(lower(p_name), 'b') ORDER BY (lower(p_name) = 'blue') DESC, starts_with(lower(p_name), 'b') DESC, p_name, p_partkey LIMIT 20 OFFSET 10)")
def search_ranked_page(spark, sf):
    """A page of a ranked search; the page is cut before its rows are enriched."""
    name = F.lower("p_name")
    hits = table(spark, sf, "part", "p_partkey", "p_name").where(name.contains("b")).withColumns({"exact": name == "blue", "prefix": name.startswith("b")})
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.desc("exact"), F.desc("prefix"), "p_name", "p_partkey").offset(10).limit(20)
    n = table(spark, sf, "lineitem", "l_partkey").join(F.broadcast(page.select("p_partkey")), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"))
    return page.join(n, "p_partkey", "left").select("p_partkey", "p_name", "exact", "prefix", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), total.scalar().alias("total"))


@query(O + " SELECT c_custkey AS cust, count(*) FILTER (WHERE status = 'F')::BIGINT AS wins, count(*) FILTER (WHERE status = 'O')::BIGINT AS losses, coalesce(string_agg(CASE WHEN rn <= 5 THEN id::VARCHAR END, ',' ORDER BY rn), '') AS last5 FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY day DESC, id DESC) AS rn FROM o) x ON x.cust = c_custkey GROUP BY 1")
def entity_profile(spark, sf):
    o = _orders(spark, sf)
    rec = o.groupBy("cust").agg(F.count_if(F.col("status") == "F").alias("wins"), F.count_if(F.col("status") == "O").alias("losses"))
    last = pit.recent(o, "cust", [F.desc("day"), F.desc("id")], 5).groupBy("cust").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "id")), False), lambda x: x["id"].cast("string")), ",").alias("last5"))
    c = table(spark, sf, "customer", "c_custkey").withColumnRenamed("c_custkey", "cust")
    return c.join(rec, "cust", "left").join(last, "cust", "left").select("cust", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("losses", F.lit(0)).alias("losses"), F.coalesce("last5", F.lit("")).alias("last5"))


@query("SELECT k FROM (SELECT l_partkey AS k FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem) UNION SELECT -n_nationkey FROM nation EXCEPT SELECT -5")
def set_operations(spark, sf):
    li = table(spark, sf, "lineitem", "l_partkey", "l_suppkey")
    both = li.select(F.col("l_partkey").alias("k")).intersect(li.select(F.col("l_suppkey").alias("k")))
    n = table(spark, sf, "nation", "n_nationkey").select((-F.col("n_nationkey")).cast("long").alias("k"))
    return both.union(n).distinct().where("k <> -5")


@query(E + " SELECT usr, id, phi, pos::INT AS pos FROM (SELECT usr, id, cents - 5000 AS phi, row_number() OVER (PARTITION BY usr ORDER BY abs(cents - 5000) DESC, id) AS pos FROM e WHERE cents - 5000 <> 0) WHERE pos <= 3")
def top_n_contributions(spark, sf):
    e = _events(spark, sf).withColumn("phi", F.col("cents") - 5000).where("phi <> 0")
    w = Window.partitionBy("usr").orderBy(F.desc(F.abs("phi")), "id")
    return e.withColumn("pos", F.row_number().over(w)).where("pos <= 3").select("usr", "id", "phi", "pos")


# --- scalar functions ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM part")
def slug(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", text.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("s"))


@query("SELECT id, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS squashed, nullif(nullif(trim(regexp_replace(state, '\\s+', ' ', 'g')), ''), 'NULL') AS state FROM fight_events")
def clean_texts(spark, sf):
    return table(spark, sf, "fight_events", "id", "name", "state").select("id", F.lower(text.squash(F.col("name"))).alias("squashed"), text.clean_text(F.col("state")).alias("state"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT feed_id, CASE WHEN regexp_matches(fight_url, '/[0-9a-f]{16}/*$') THEN regexp_extract(fight_url, '([0-9a-f]{16})/*$', 1) END AS strict, CASE WHEN fight_url IS NOT NULL THEN 'http://stats.example' || regexp_replace(regexp_extract(fight_url, '^https?://[^/]*([^#]*)', 1), '/+$', '') END AS url FROM feed_rows")
def url_ids(spark, sf):
    return table(spark, sf, "feed_rows", "feed_id", "fight_url").select("feed_id", text.strict_id(F.col("fight_url")).alias("strict"), text.canonical_url(F.col("fight_url"), ["stats.example"]).alias("url"))


@query("SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS landed, (l_quantity + l_linenumber)::BIGINT AS attempted, (l_linenumber * 60 + l_quantity::BIGINT % 60)::BIGINT AS seconds, round((5 * 12 + l_linenumber) * 2.54, 2)::DOUBLE AS cm FROM lineitem")
def parse_of_clock_height(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    q = F.col("l_quantity").cast("long")
    of = text.parse_of(F.concat(q, F.lit(" of "), q + F.col("l_linenumber")))
    clock = text.clock_seconds(F.concat("l_linenumber", F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0")))
    return li.select("l_orderkey", "l_linenumber", of.alias("x"), clock.alias("seconds"), text.height_cm(F.concat(F.lit("5' "), "l_linenumber", F.lit('"'))).alias("cm")).select("l_orderkey", "l_linenumber", "x.landed", "x.attempted", "seconds", "cm")


@query("SELECT id, CASE WHEN i >= 2 THEN CASE WHEN i = 2 THEN p[1] ELSE array_to_string(p[1:i-2], ', ') END END AS city, CASE WHEN i >= 3 THEN p[i-1] END AS state, p[i] AS country FROM (SELECT id, string_split(loc, ', ') AS p, len(string_split(loc, ', ')) AS i FROM (SELECT id, concat_ws(', ', city, nullif(state, 'NULL'), country) AS loc FROM fight_events)) WHERE i > 0 AND p[1] <> ''")
def split_location(spark, sf):
    e = table(spark, sf, "fight_events", "id", "city", "state", "country").select("id", F.concat_ws(", ", "city", F.nullif("state", F.lit("NULL")), "country").alias("loc")).where("loc <> ''")
    return e.select("id", text.split_location(F.col("loc")).alias("x")).select("id", "x.city", "x.state", "x.country")


@query("SELECT row_id, round(CASE WHEN red_odds > 0 THEN 1 + red_odds::DECIMAL(12,2) / 100 WHEN red_odds < 0 THEN 1 + 100 / -(red_odds::DECIMAL(12,2)) END + 1e-12, 3)::DOUBLE AS price FROM mdabbert_rows WHERE red_odds IS NOT NULL AND NOT isnan(red_odds)")
def moneyline_decimal(spark, sf):
    m = table(spark, sf, "mdabbert_rows", "row_id", "red_odds").where("red_odds is not null and not isnan(red_odds)")
    return m.select("row_id", domain.moneyline_decimal(F.col("red_odds")).alias("price"))


@query("SELECT feed_id, round(CASE WHEN odds_1 > 1 AND odds_2 > 1 THEN (1 / odds_1) / (1 / odds_1 + 1 / odds_2) END, 9) AS p FROM feed_rows WHERE NOT coalesce(isnan(odds_1) OR isnan(odds_2), false)")
def devig(spark, sf):
    f = table(spark, sf, "feed_rows", "feed_id", "odds_1", "odds_2").where("not coalesce(isnan(odds_1) or isnan(odds_2), false)")
    return f.select("feed_id", F.round(domain.devig(F.col("odds_1"), F.col("odds_2")), 9).alias("p"))


@query("SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(CASE WHEN p <> 0.5 THEN CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END END), 9)::DOUBLE AS accuracy FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, least(greatest(l_discount * 5, 1e-15), 1 - 1e-15) AS p FROM lineitem)")
def logloss_brier(spark, sf):
    li = table(spark, sf, "lineitem", "l_returnflag", "l_discount").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.least(F.greatest(F.col("l_discount") * 5, F.lit(1e-15)), F.lit(1 - 1e-15)).alias("p"))
    y, p = F.col("y"), F.col("p")
    return li.agg(F.round(domain.log_loss(y, p), 9).alias("log_loss"), F.round(domain.brier(y, p), 9).alias("brier"), F.round(domain.accuracy(y, p), 9).alias("accuracy"))


@query("SELECT id, CASE WHEN stance IS NULL OR lower(trim(stance)) IN ('', 'unknown') THEN 'unknown' WHEN lower(trim(stance)) IN ('orthodox','southpaw','switch') THEN lower(trim(stance)) ELSE 'other' END AS stance, year(DATE '2024-06-30') - year(dob) - CASE WHEN strftime(dob, '%m%d') > '0630' THEN 1 ELSE 0 END AS age FROM fighters")
def stance_and_age(spark, sf):
    f = table(spark, sf, "fighters", "id", "stance", "dob")
    return f.select("id", domain.stance(F.col("stance")).alias("stance"), domain.whole_years(F.col("dob"), F.lit("2024-06-30").cast("date")).cast("long").alias("age"))


@query("SELECT o_orderkey, (o_orderdate - INTERVAL 12 MONTH)::DATE AS year_before, (o_orderdate - INTERVAL 5 MONTH)::DATE AS months_before, (timezone('America/New_York', timezone('UTC', o_orderdate)))::DATE AS local_day FROM orders")
def date_functions(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", F.add_months(d, -12).alias("year_before"), F.add_months(d, -5).alias("months_before"), domain.app_today(F.col("o_orderdate"), "America/New_York").alias("local_day"))


@query("SELECT id, split_part(x, '|', 1) AS split, strftime(d, '%Y%m%d-%H%M%S') AS version FROM (SELECT o_orderkey AS id, o_orderdate AS d, CASE WHEN o_orderdate::DATE > m - 365 THEN 'test|' WHEN o_orderdate::DATE > m - 365 - 365 THEN 'val|' ELSE 'train|' END AS x FROM orders, (SELECT max(o_orderdate::DATE) AS m FROM orders))")
def split_boundaries(spark, sf):
    """Test is the last 365 days, validation the 365 before, training the rest."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    m = o.agg(F.max(F.to_date("o_orderdate")).alias("m"))
    d = F.to_date("o_orderdate")
    last = m.scalar()
    return o.select(F.col("o_orderkey").alias("id"), F.when(d > F.date_sub(last, 365), "test").when(d > F.date_sub(last, 730), "val").otherwise("train").alias("split"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss").alias("version"))


# --- rate limits, windows ------------------------------------------------------------------------------------


@query(E + ", r AS (SELECT id, usr, us, row_number() OVER (PARTITION BY usr ORDER BY us, id) - 1 AS n FROM e) SELECT id, (n * 3600000000 + max(us - n * 3600000000) OVER (PARTITION BY usr ORDER BY us, id ROWS UNBOUNDED PRECEDING))::BIGINT AS slot FROM r")
def slot_reservation(spark, sf):
    return limits.reserve_slots(_events(spark, sf).select("id", "usr", "us"), "usr", "us", "id", 3_600_000_000).select("id", "slot")


@query()
def token_bucket(spark, sf):
    e = _events(spark, sf).select("id", "usr", (F.col("us") / 1e6).alias("s"))
    return limits.token_bucket(e, "usr", "s", "id", [(2.0, 1 / 7200), (5.0, 1 / 86400)]).select("usr", "id", "allowed")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type AS kind, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "kind", "n")


@query("SELECT b AS start_us, count(*)::BIGINT AS n FROM (SELECT unnest([epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) - k * 900000000 FOR k IN range(4)]) AS b FROM events) GROUP BY 1")
def sliding(spark, sf):
    return _events(spark, sf).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "n")


@query(E + ", g AS (SELECT usr, us, CASE WHEN us - lag(us) OVER (PARTITION BY usr ORDER BY us, id) < 14400000000 THEN 0 ELSE 1 END AS s FROM e), n AS (SELECT usr, us, sum(s) OVER (PARTITION BY usr ORDER BY us, s DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT usr, min(us) AS start_us, count(*)::BIGINT AS n FROM n GROUP BY usr, k")
def session_counts(spark, sf):
    return _events(spark, sf).groupBy("usr", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n")).select("usr", F.unix_micros("w.start").alias("start_us"), "n")
