"""The feature pipeline over bouts, and reports and serving queries on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.functions import domain
from tallyspan.operators import aggregate, asof, pit, sides
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


def bouts(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts with their day, spelled alike: status, outcome, method, duration and the reason where it is unknown."""
    e = table(spark, sf, "fight_events", "id", "event_date").select(F.col("id").alias("event_id"), F.col("event_date").alias("day"))
    f = table(spark, sf, "fights", "id", "event_id", "fighter_a_id", "fighter_b_id", "winner_id", "outcome", "method", "status", "scheduled_rounds", "finish_round", "finish_time_sec", "weight_class", "is_title_fight")
    seconds, reason = pit.fight_duration(F.col("scheduled_rounds"), F.col("finish_round"), F.col("finish_time_sec"), F.col("method"))
    return f.join(e, "event_id").withColumns({"duration_sec": seconds.cast("long"), "duration_reason": reason})


def sided_history(spark: SparkSession, sf: str) -> DataFrame:
    """One row per side of every completed bout: entity, day, id, result, finish flag, duration."""
    done = bouts(spark, sf).where("status = 'completed'")
    s = sides.explode_sides(done, "fighter_a_id", "fighter_b_id", entity="fighter_id", opponent="opponent_id")
    result = sides.perspective(F.col("fighter_id"), F.col("winner_id"), F.col("outcome"))
    return s.select("id", "fighter_id", "opponent_id", "day", "method", "duration_sec", "weight_class", result.alias("result"))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """Features of each side of each completed bout from strictly earlier days; one shuffle by fighter for all."""
    h = sided_history(spark, sf)
    won, finish = F.col("result") == "win", F.col("method").isin("ko_tko", "submission")
    known = F.col("result").isin("win", "loss", "draw", "nc")
    out = pit.career(h, "fighter_id", "day", n_fights=F.count("*"), wins=F.sum(won.cast("long")), finishes=F.sum((won & finish).cast("long")), minutes_known=F.sum("duration_sec"))
    out = out.withColumn("days_since_last", pit.days_since_last("fighter_id", "day"))
    out = pit.trailing(out, "fighter_id", "day", "id", 3, wins_last3=F.sum(won.cast("long")), sec_last3=F.sum("duration_sec"))
    out = pit.trailing(out, "fighter_id", "day", "id", 5, wins_last5=F.sum(won.cast("long")))
    kind = F.when(won, "win").when(F.col("result").isin("loss", "draw"), "stop").when(F.col("result") == "nc", "skip").otherwise("unknown")
    out = pit.streak(out, "fighter_id", "day", "id", F.when(known | F.col("result").isNotNull(), kind), "win_streak")
    bio = table(spark, sf, "fighters", "id", "dob", "stance").select(F.col("id").alias("fighter_id"), "dob", domain.stance(F.col("stance")).alias("stance"))
    out = out.join(bio, "fighter_id", "left")
    return out.select(
        F.col("id").alias("fight_id"), "fighter_id", "day", "n_fights", F.coalesce("wins", F.lit(0)).alias("wins"),
        F.round(pit.safe_ratio(F.col("finishes").cast("double"), F.col("wins").cast("double")), 9).alias("finish_rate"),
        "minutes_known", "days_since_last", "wins_last3", "sec_last3", "wins_last5", "win_streak", F.datediff("day", "dob").alias("age_days"), "stance",
    )


_BOUTS = """b AS (SELECT f.*, e.event_date AS day FROM fights f JOIN fight_events e ON e.id = f.event_id),
d AS (SELECT *, CASE WHEN finish_round IS NULL OR finish_time_sec IS NULL THEN 'no_finish_time' WHEN finish_time_sec < 0 OR finish_time_sec > 300 THEN 'impossible_time'
  WHEN scheduled_rounds IS NULL OR scheduled_rounds < 1 THEN 'unknown_rounds' WHEN finish_round < 1 OR finish_round > scheduled_rounds THEN 'impossible_round'
  WHEN method = 'decision' AND (finish_round < scheduled_rounds OR finish_time_sec < 300) THEN 'decision_before_the_end' END AS reason FROM b),
h AS (SELECT d.id, s.fighter_id, day, method, CASE WHEN reason IS NULL THEN (finish_round - 1) * 300 + finish_time_sec END::BIGINT AS sec,
  CASE WHEN lower(trim(outcome)) = 'win' THEN CASE WHEN winner_id IS NULL THEN 'unknown' WHEN winner_id = s.fighter_id THEN 'win' ELSE 'loss' END
    WHEN lower(trim(outcome)) = 'draw' THEN 'draw' WHEN lower(trim(outcome)) IN ('no_contest','no contest','nc') THEN 'nc' ELSE 'unknown' END AS result
  FROM d, LATERAL (VALUES (fighter_a_id), (fighter_b_id)) s(fighter_id) WHERE status = 'completed')"""


@query("WITH " + _BOUTS + """, p AS (SELECT x.id, x.fighter_id, y.id AS pid, y.day AS pday, y.result, y.method, y.sec, row_number() OVER (PARTITION BY x.id, x.fighter_id ORDER BY y.day DESC, y.id DESC) AS rn FROM h x JOIN h y ON y.fighter_id = x.fighter_id AND y.day < x.day),
a AS (SELECT id, fighter_id, count(*) AS n, count(*) FILTER (WHERE result = 'win') AS w, count(*) FILTER (WHERE result = 'win' AND method IN ('ko_tko','submission')) AS fin, sum(sec) AS sec, max(pday) AS last,
  count(*) FILTER (WHERE rn <= 3 AND result = 'win') AS w3, sum(sec) FILTER (WHERE rn <= 3) AS s3, count(*) FILTER (WHERE rn <= 5 AND result = 'win') AS w5,
  min(rn) FILTER (WHERE result IN ('loss','draw','unknown')) AS stop, arg_min(result, rn) FILTER (WHERE result IN ('loss','draw','unknown')) AS stop_kind FROM p GROUP BY 1, 2),
k AS (SELECT a.id, a.fighter_id, count(*) FILTER (WHERE p.result = 'win' AND (a.stop IS NULL OR p.rn < a.stop)) AS streak FROM a JOIN p USING (id, fighter_id) GROUP BY 1, 2)
SELECT h.id AS fight_id, h.fighter_id, h.day, coalesce(n, 0)::BIGINT AS n_fights, coalesce(w, 0)::BIGINT AS wins, round(CASE WHEN w > 0 THEN fin::DOUBLE / w END, 9) AS finish_rate, sec_sum::BIGINT AS minutes_known, date_diff('day', last, h.day)::INT AS days_since_last,
  w3::BIGINT AS wins_last3, s3::BIGINT AS sec_last3, w5::BIGINT AS wins_last5, CASE WHEN stop_kind = 'unknown' THEN NULL ELSE coalesce(streak, 0) END::BIGINT AS win_streak, date_diff('day', dob, h.day)::INT AS age_days,
  CASE WHEN stance IS NULL OR lower(trim(stance)) IN ('', 'unknown') THEN 'unknown' WHEN lower(trim(stance)) IN ('orthodox','southpaw','switch') THEN lower(trim(stance)) ELSE 'other' END AS stance
FROM h LEFT JOIN (SELECT * RENAME (sec AS sec_sum) FROM a) a USING (id, fighter_id) LEFT JOIN k USING (id, fighter_id) LEFT JOIN fighters ON fighters.id = h.fighter_id""")
def feature_rows(spark, sf):
    return feature_table(spark, sf)


@query("WITH " + _BOUTS + " SELECT id, CASE WHEN reason IS NULL THEN (finish_round - 1) * 300 + finish_time_sec END::BIGINT AS duration_sec, reason AS duration_reason FROM d")
def fight_durations(spark, sf):
    return bouts(spark, sf).select("id", "duration_sec", "duration_reason")


@query("WITH " + _BOUTS + " SELECT coalesce(reason, 'known') AS reason, count(*)::BIGINT AS n, min(day) AS first_day, max(day) AS last_day FROM d WHERE status = 'completed' GROUP BY 1")
def build_report(spark, sf):
    return bouts(spark, sf).where("status = 'completed'").groupBy(F.coalesce("duration_reason", F.lit("known")).alias("reason")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("WITH " + _BOUTS + " SELECT id, day, status, CASE WHEN status = 'completed' THEN 'history' WHEN status = 'scheduled' AND day >= DATE '2024-08-01' - 1 THEN 'upcoming' WHEN status = 'scheduled' THEN 'stale' ELSE 'off' END AS target FROM b")
def target_selection(spark, sf):
    """Completed bouts and upcoming ones from yesterday on; older scheduled ones are reported as stale."""
    late = F.col("day") >= F.date_sub(F.lit("2024-08-01").cast("date"), 1)
    t = F.when(F.col("status") == "completed", "history").when((F.col("status") == "scheduled") & late, "upcoming").when(F.col("status") == "scheduled", "stale").otherwise("off")
    return bouts(spark, sf).select("id", "day", "status", t.alias("target"))


@query("""WITH x AS (SELECT f.id, year(e.event_date)::INT AS y, count(DISTINCT ff.fighter_id) AS n FROM fights f JOIN fight_events e ON e.id = f.event_id LEFT JOIN fight_features ff ON ff.fight_id = f.id WHERE f.status = 'completed' GROUP BY ALL)
SELECT y, count(*)::BIGINT AS bouts, count(*) FILTER (WHERE n = 2)::BIGINT AS complete, count(*) FILTER (WHERE n = 1)::BIGINT AS one_side, count(*) FILTER (WHERE n = 0)::BIGINT AS missing, round(100.0 * count(*) FILTER (WHERE n < 2) / count(*), 1)::DOUBLE AS gap_pct FROM x GROUP BY 1""")
def stats_gap(spark, sf):
    n = table(spark, sf, "fight_features", "fight_id", "fighter_id").groupBy("fight_id").agg(F.countDistinct("fighter_id").alias("n"))
    x = bouts(spark, sf).where("status = 'completed'").select(F.col("id").alias("fight_id"), F.year("day").alias("y")).join(n, "fight_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = x.groupBy("y").agg(F.count("*").alias("bouts"), F.count_if(F.col("n") == 2).alias("complete"), F.count_if(F.col("n") == 1).alias("one_side"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("n") < 2).alias("_gap"))
    return g.withColumn("gap_pct", aggregate.share(F.col("_gap"), F.col("bouts"))).drop("_gap")


@query("""SELECT coalesce(source, 'all') AS source, coalesce(region, 'all') AS region, count(*)::BIGINT AS n, count(*) FILTER (WHERE odds_1 > 1 AND odds_2 > 1 AND NOT isnan(odds_1) AND NOT isnan(odds_2))::BIGINT AS usable FROM feed_rows GROUP BY ROLLUP (source, region)""")
def odds_summary(spark, sf):
    f = table(spark, sf, "feed_rows", "source", "region", "odds_1", "odds_2")
    ok = (F.col("odds_1") > 1) & (F.col("odds_2") > 1) & ~F.isnan("odds_1") & ~F.isnan("odds_2")
    return f.rollup("source", "region").agg(F.count("*").alias("n"), F.count_if(ok).alias("usable")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("region", F.lit("all")).alias("region"), "n", "usable")


_FEED = """WITH q AS (SELECT *, (1 / odds_1) / (1 / odds_1 + 1 / odds_2) AS p, row_number() OVER (PARTITION BY fight_url, name_1, source, region ORDER BY added DESC, feed_id DESC) AS rn
  FROM feed_rows WHERE fight_url IS NOT NULL AND added::DATE <= event_date AND odds_1 > 1 AND odds_2 > 1 AND NOT isnan(odds_1) AND NOT isnan(odds_2))"""


@query(_FEED + " SELECT fight_url, name_1, round(avg(p), 9) AS probability, count(*)::BIGINT AS quotes, max(added) AS freshest FROM q WHERE rn = 1 GROUP BY 1, 2")
def feed_consensus(spark, sf):
    """Per bout and first name: last usable quote of each bookmaker and region up to the day, without margin, averaged."""
    f = table(spark, sf, "feed_rows", "feed_id", "fight_url", "name_1", "source", "region", "odds_1", "odds_2", "added", "event_date")
    f = f.where("fight_url is not null and to_date(added) <= event_date and not isnan(odds_1) and not isnan(odds_2)")
    out = aggregate.consensus(f, ["fight_url", "name_1"], ["source", "region"], "added", "feed_id", domain.devig(F.col("odds_1"), F.col("odds_2")))
    return out.select("fight_url", "name_1", F.round("probability", 9).alias("probability"), "quotes", "freshest")


@query("""WITH l AS (SELECT fight_id, fighter_id, arg_max(win_streak, built_at) AS streak, arg_max(age_days, built_at) AS age FROM (SELECT * FROM fight_features WHERE built_at IS NOT NULL AND win_streak IS NOT NULL AND age_days IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fight_id, fighter_id ORDER BY built_at DESC, load_run_id DESC) = 1) GROUP BY 1, 2),
o AS (SELECT fight_id, max(row_id) AS row_id FROM mdabbert_rows WHERE fight_id IS NOT NULL GROUP BY 1)
SELECT f.id AS fight_id, a.streak::BIGINT AS a_streak, b.streak::BIGINT AS b_streak, (a.streak - b.streak)::BIGINT AS d_streak, (a.age - b.age)::BIGINT AS d_age, o.row_id, CASE WHEN f.winner_id = f.fighter_a_id THEN 1 WHEN f.winner_id = f.fighter_b_id THEN 0 END::INT AS label
FROM fights f JOIN l a ON a.fight_id = f.id AND a.fighter_id = f.fighter_a_id JOIN l b ON b.fight_id = f.id AND b.fighter_id = f.fighter_b_id LEFT JOIN o ON o.fight_id = f.id WHERE f.status = 'completed'""")
def dataset_assembly(spark, sf):
    """Facts with the latest features of both sides and, where there is one, the price row."""
    ff = table(spark, sf, "fight_features", "fight_id", "fighter_id", "win_streak", "age_days", "built_at", "load_run_id").where("built_at is not null and win_streak is not null and age_days is not null")
    last = asof.latest_per_key(ff, ["fight_id", "fighter_id"], [F.col("built_at"), F.col("load_run_id")], ["win_streak", "age_days"])
    side = lambda s: last.select("fight_id", F.col("fighter_id").alias(f"fighter_{s}_id"), F.col("win_streak").cast("long").alias(f"{s}_streak"), F.col("age_days").cast("long").alias(f"{s}_age"))
    odds = table(spark, sf, "mdabbert_rows", "fight_id", "row_id").where("fight_id is not null").groupBy("fight_id").agg(F.max("row_id").alias("row_id"))
    f = table(spark, sf, "fights", "id", "fighter_a_id", "fighter_b_id", "winner_id", "status").where("status = 'completed'").withColumnRenamed("id", "fight_id")
    j = f.join(side("a"), ["fight_id", "fighter_a_id"]).join(side("b"), ["fight_id", "fighter_b_id"]).join(odds, "fight_id", "left")
    label = F.when(F.col("winner_id") == F.col("fighter_a_id"), 1).when(F.col("winner_id") == F.col("fighter_b_id"), 0)
    return j.select("fight_id", "a_streak", "b_streak", (F.col("a_streak") - F.col("b_streak")).alias("d_streak"), (F.col("a_age") - F.col("b_age")).alias("d_age"), "row_id", label.alias("label"))


@query("""WITH r AS (SELECT s.fighter_id, f.winner_id, lower(trim(f.outcome)) AS o FROM fights f, LATERAL (VALUES (fighter_a_id), (fighter_b_id)) s(fighter_id) WHERE status = 'completed')
SELECT id, name, count(r.fighter_id)::BIGINT AS bouts, count(*) FILTER (WHERE o = 'win' AND winner_id = id)::BIGINT AS wins FROM fighters LEFT JOIN r ON r.fighter_id = id WHERE lower(name) LIKE 'a%' GROUP BY 1, 2""")
def profile_search(spark, sf):
    people = table(spark, sf, "fighters", "id", "name").where(F.lower("name").startswith("a"))
    s = sides.explode_sides(table(spark, sf, "fights", "fighter_a_id", "fighter_b_id", "winner_id", "outcome", "status").where("status = 'completed'"), "fighter_a_id", "fighter_b_id", entity="id")
    rec = s.groupBy("id").agg(F.count("*").alias("bouts"), F.count_if((F.lower(F.trim("outcome")) == "win") & (F.col("winner_id") == F.col("id"))).alias("wins"))
    return people.join(rec, "id", "left").select("id", "name", F.coalesce("bouts", F.lit(0)).alias("bouts"), F.coalesce("wins", F.lit(0)).alias("wins"))


@query("""WITH up AS (SELECT f.id, e.event_date AS day, f.fighter_a_id AS a, f.fighter_b_id AS b FROM fights f JOIN fight_events e ON e.id = f.event_id WHERE f.status = 'scheduled'),
h AS (SELECT s.fighter_id, e.event_date AS day FROM fights f JOIN fight_events e ON e.id = f.event_id, LATERAL (VALUES (fighter_a_id), (fighter_b_id)) s(fighter_id) WHERE status = 'completed')
SELECT id, day, (SELECT count(*) FROM h WHERE h.fighter_id = a AND h.day < up.day)::BIGINT AS a_prior, (SELECT count(*) FROM h WHERE h.fighter_id = b AND h.day < up.day)::BIGINT AS b_prior FROM up""")
def upcoming_batch(spark, sf):
    """Scheduled bouts with both sides' history counts, all in one pass instead of a query each."""
    b = bouts(spark, sf)
    up = b.where("status = 'scheduled'").select("id", "day", "fighter_a_id", "fighter_b_id")
    ask = sides.explode_sides(up, "fighter_a_id", "fighter_b_id", entity="fighter_id").select("id", "day", "side", "fighter_id")
    h = sides.explode_sides(b.where("status = 'completed'").select("fighter_a_id", "fighter_b_id", F.col("day").alias("d")), "fighter_a_id", "fighter_b_id", entity="fighter_id").select("fighter_id", "d")
    n = ask.join(h, "fighter_id", "left").groupBy("id", "day", "side").agg(F.count_if(F.col("d") < F.col("day")).alias("n"))
    return n.groupBy("id", "day").agg(F.max(F.when(F.col("side") == "a", F.col("n"))).alias("a_prior"), F.max(F.when(F.col("side") == "b", F.col("n"))).alias("b_prior"))


@query("WITH o AS (SELECT id, weight_class, lead(id) OVER (PARTITION BY weight_class ORDER BY id) AS nxt FROM (SELECT DISTINCT fighter_a_id AS id, weight_class FROM fights WHERE weight_class IS NOT NULL)) SELECT weight_class, id AS a, nxt AS b FROM o WHERE nxt IS NOT NULL")
def request_pairs(spark, sf):
    """Pairs of one class for load tests: neighbours in a fixed order, so their number is that of the entities."""
    p = table(spark, sf, "fights", "fighter_a_id", "weight_class").where("weight_class is not null").select(F.col("fighter_a_id").alias("id"), "weight_class").distinct()
    return p.withColumn("b", F.lead("id").over(Window.partitionBy("weight_class").orderBy("id"))).where("b is not null").select("weight_class", F.col("id").alias("a"), "b")


@query()
def symmetric_predictions(spark, sf):
    """Win model with early stopping, scored in both orders on the whole data set."""
    from tallyspan.ml import training as ml

    e = bouts(spark, sf).select(F.col("id").alias("fight_id"), "day")
    d = dataset_assembly(spark, sf).where("label is not null").join(e, "fight_id")
    d = d.select("fight_id", "day", F.col("label").cast("double").alias("label"), F.col("a_streak").alias("a_streak"), F.col("b_streak").alias("b_streak"), F.col("d_age").cast("double").alias("a_age"), F.lit(0.0).alias("b_age"))
    d = ml.time_split(d, "day", 120, 120)
    model = ml.fit_win(d, ["streak", "age"], "label", trees=20)
    return model.score(d).select("fight_id", "split", "label", "p")
