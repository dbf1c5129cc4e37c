"""Queries p3, p4, p5, p7, p8 and p9 over the tables of a data folder, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import abuse, crossmatch, pack, survive, tokenize, variants
from tallyspan.session import stored
from tallyspan.sources.tables import table

CAPACITY = 2048


def p3_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with their confidence."""
    typed = table(spark, sf, "mdabbert_rows", "row_id", "fight_id", "red_name", "blue_name", "bout_date", "red_odds", "blue_odds")
    feed = table(spark, sf, "feed_rows", "feed_id", "fight_url", "name_1", "name_2", "odds_1", "odds_2", "event_date")
    return crossmatch.matched_prices(typed, feed, table(spark, sf, "fights", "id", "ufcstats_id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_matches(spark, sf).select("row_id", "feed_id").distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return survive.surviving_bouts(table(spark, sf, "fights"), table(spark, sf, "fight_events"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    typed = table(spark, sf, "mdabbert_rows", "row_id", "fight_id", "red_name", "blue_name", "bout_date").where("fight_id is null")
    return variants.linked_names(typed, table(spark, sf, "aliases"), table(spark, sf, "fighters"), table(spark, sf, "fights"), table(spark, sf, "fight_events"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokenize.encode(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", counts=True)
    return pack.pack(stored(sizes, "sizes"), "doc_id", "n_tokens", CAPACITY)


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its score and the spans that offend."""
    return abuse.score_documents(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labelled_comments", "text", "label"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).where(f"score >= {abuse.THRESHOLD}").select("doc_id")


def p9_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    scored = stored(p9_scores(spark, sf).select("doc_id", "score"), "scores")
    return abuse.rates(table(spark, sf, "documents", "doc_id", "source").join(scored, "doc_id"), "source")


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p4_found": p4_found, "p5_found": p5_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_scores": p9_scores, "p9_source_rates": p9_source_rates}

ORACLE = {
    "p4_found": """
WITH r AS (
  SELECT f.id, least(fighter_a_id, fighter_b_id) AS lo, greatest(fighter_a_id, fighter_b_id) AS hi, e.event_date AS day, winner_id, loaded_at,
    CASE result_source WHEN 'ufcstats' THEN 2 WHEN 'wikipedia' THEN 1 ELSE 0 END AS trust,
    CASE regexp_replace(lower(trim(outcome)), '[\\s_-]+', ' ', 'g') WHEN 'win' THEN 'win' WHEN 'draw' THEN 'draw' WHEN 'no contest' THEN 'no_contest' WHEN 'nc' THEN 'no_contest' END AS o
  FROM fights f JOIN fight_events e ON e.id = f.event_id WHERE fighter_a_id IS NOT NULL AND fighter_b_id IS NOT NULL AND e.event_date IS NOT NULL
), m AS (
  SELECT *, CASE WHEN day - lag(day) OVER w > 1 THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY lo, hi ORDER BY day, id)
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY lo, hi ORDER BY day, id) AS run FROM m
), k AS (
  SELECT min(id) AS group_id, count(*) AS n,
    first(o ORDER BY trust DESC, loaded_at DESC NULLS LAST, id) FILTER (WHERE o IS NOT NULL) AS o,
    first(winner_id ORDER BY trust DESC, loaded_at DESC NULLS LAST, id) FILTER (WHERE o = 'win' AND (winner_id = lo OR winner_id = hi)) AS w
  FROM g GROUP BY lo, hi, run
)
SELECT group_id, coalesce(o, 'unknown') AS outcome, CASE WHEN o = 'win' THEN coalesce(w, 0) ELSE 0 END::BIGINT AS winner_id FROM k WHERE n > 1""",
}
