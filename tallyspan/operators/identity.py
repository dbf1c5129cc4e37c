"""Identity of events and entities across sources, guarded links and small merge rules."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def resolve_events(incoming: DataFrame, by_link: DataFrame, by_members: DataFrame) -> DataFrame:
    """(article_id, event_id, status): an event by its link, else by the matched members, else to be created.

    ``incoming``: article_id; ``by_link``: article_id, event_id; ``by_members``: article_id, event_id for each matched
    member. Members that point to several events, or to another one than the link, are a collision.
    """
    m = by_members.groupBy("article_id").agg(F.countDistinct("event_id").alias("_n"), F.min("event_id").alias("_m"))
    one = by_link.groupBy("article_id").agg(F.countDistinct("event_id").alias("_ln"), F.min("event_id").alias("_l"))
    j = incoming.select("article_id").distinct().join(one, "article_id", "left").join(m, "article_id", "left")
    clash = (F.col("_n") > 1) | (F.col("_ln") > 1) | (F.col("_l") != F.col("_m"))
    status = F.when(F.coalesce(clash, F.lit(False)), "collision").when(F.col("_l").isNotNull(), "linked").when(F.col("_m").isNotNull(), "matched").otherwise("create")
    return j.select("article_id", F.when(status != "collision", F.coalesce("_l", "_m")).alias("event_id"), status.alias("status"))


def resolve_entities(incoming: DataFrame, links: DataFrame, resolved: DataFrame, suspects: DataFrame) -> DataFrame:
    """(title, entity, status): by link, else by resolved name; ambiguous names and suspected duplicates are held, the rest become stubs.

    ``links``: title, entity; ``resolved``: title, entity, name_status; ``suspects``: title.
    """
    l = links.select("title", F.col("entity").alias("_l"))  # noqa: E741
    r = resolved.select("title", F.col("entity").alias("_r"), "name_status")
    s = suspects.select("title").distinct().withColumn("_s", F.lit(True))
    j = incoming.select("title").distinct().join(l, "title", "left").join(r, "title", "left").join(s, "title", "left")
    status = F.when(F.col("_l").isNotNull(), "linked").when(F.col("_r").isNotNull(), "named").when(F.col("name_status") == "ambiguous", "ambiguous").when(F.col("_s"), "held").otherwise("stub")
    return j.select("title", F.coalesce("_l", "_r").alias("entity"), status.alias("status"))


def link_if_free(held: DataFrame, new: DataFrame, key: str, link: str) -> DataFrame:
    """Held rows with new links, where neither the row has a link nor another row has this one."""
    taken = held.where(F.col(link).isNotNull()).select(F.col(link).alias("_new"))
    free = new.select(key, F.col(link).alias("_new")).join(taken, "_new", "left_anti").groupBy("_new").agg(F.min(key).alias(key))
    return held.join(free, key, "left").withColumn(link, F.coalesce(link, "_new")).select(*held.columns)


def cancel_scheduled(df: DataFrame, event: str, events: list, status: str = "status") -> DataFrame:
    hit = F.col(event).isin(events) & (F.col(status) == "scheduled")
    return df.withColumn(status, F.when(hit, "cancelled").otherwise(F.col(status)))


def fill_unknown(outcome: Column, new: Column) -> Column:
    """A new outcome only where the held one is ``unknown``."""
    return F.when((outcome == "unknown") & new.isNotNull(), new).otherwise(outcome)


def known_differences(a: str, b: str, columns: list[str], strict: list[str] = ()) -> Column:
    """Columns in which two structs differ; one unknown side is no difference, save in ``strict`` columns."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    cell = lambda c: F.when(~x(c).eqNullSafe(y(c)) if c in strict else x(c) != y(c), F.lit(c))
    return F.filter(F.array(*(cell(c) for c in columns)), lambda v: v.isNotNull())


def default_rounds(requested: Column, title: Column) -> Column:
    return F.coalesce(requested, F.when(title, 5).otherwise(3))


def resolve_class(requested: Column, recent_a: Column, recent_b: Column) -> Column:
    """struct(weight_class, status): the request, else the class both sides fought in last, else an error with detail."""
    same = recent_a == recent_b
    return F.struct(
        F.coalesce(requested, F.when(same, recent_a)).alias("weight_class"),
        F.when(requested.isNotNull(), "requested").when(same, "recent").when(recent_a.isNull() | recent_b.isNull(), "no recent class").otherwise(F.concat(F.lit("classes differ: "), recent_a, F.lit(" and "), recent_b)).alias("status"),
    )


def quality(updated: Column, build: Column, rates: list[Column]) -> Column:
    """struct(current, complete, note) of an entity's features."""
    current, complete = updated >= build, F.forall(F.array(*(r.isNotNull() for r in rates)), lambda x: x)
    note = F.concat_ws("; ", F.when(~F.coalesce(current, F.lit(False)), "features are older than the latest bout"), F.when(~complete, "some rates are unknown"))
    return F.struct(F.coalesce(current, F.lit(False)).alias("current"), complete.alias("complete"), note.alias("note"))


def cache_ttl(kind: Column, status: Column, day: Column, today: Column) -> Column:
    """Seconds that a page of a kind holds; null is for ever: past results don't change."""
    past = day < F.date_sub(today, 7)
    return F.when(kind.isin("fight", "event") & past & (status == "completed"), None).when(kind == "list", 6 * 3600).when(kind == "fighter", 7 * 86400).otherwise(3600).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks of two texts (2 M / T); an Arrow function, for candidates of a block only."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def orient_first(first_id: Column, a_id: Column, first_name: Column, a_name: Column, b_name: Column) -> Column:
    """Whether a feed's first name is our first side: by id, by equal name, else by the closer name."""
    return F.when(first_id.isNotNull(), first_id == a_id).when(first_name == a_name, True).when(first_name == b_name, False).otherwise(ratio(first_name, a_name) >= ratio(first_name, b_name))


def golden_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """JSON lines with sorted fields in the order of a natural key, for comparison with stored results."""
    return df.orderBy(*key).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


# Classes with their limit marks in either source's spelling.
CLASSES = ("Flyweight", "Bantamweight", "Featherweight", "Lightweight", "Welterweight", "Middleweight", "Light Heavyweight", "Heavyweight")


def class_lookup(text: Column) -> Column:
    """struct(weight_class, women, title, kind) of a class text; catch and open weights by their prefix, unknown ones null."""
    t = F.lower(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))
    women = t.contains("women")
    base = F.trim(F.regexp_replace(t, r"women'?s|ufc|interim|title|championship|bout|\(.*\)|pound-for-pound", ""))
    base = F.trim(F.regexp_replace(base, " +", " "))
    named = None
    for c in (*CLASSES, "Strawweight"):
        named = F.when(base == c.lower(), c) if named is None else named.when(base == c.lower(), c)
    kind = F.when(t.contains("pound-for-pound"), "p4p").when(base.startswith("catch"), "catch").when(base.startswith("open"), "open").when(named.isNotNull(), "division")
    name = F.when(kind == "catch", "Catch Weight").when(kind == "open", "Open Weight").when(named.isNotNull(), F.concat(F.when(women, "Women's ").otherwise(""), named))
    return F.struct(name.alias("weight_class"), women.alias("women"), t.rlike("title|championship").alias("title"), kind.alias("kind"))


def method_text(text: Column) -> Column:
    """struct(method, decision_type, detail) of ``Submission (rear naked choke)`` or ``Decision (split)``; unknown heads are null."""
    head, detail = F.lower(F.trim(F.regexp_extract(text, r"^([^(]*)", 1))), F.nullif(F.trim(F.regexp_extract(text, r"\(([^)]*)\)", 1)), F.lit(""))
    method = F.when(head.isin("ko", "tko", "ko/tko"), "ko_tko").when(head.startswith("submission"), "submission").when(head.startswith("decision"), "decision").when(head.isin("dq", "disqualification"), "dq").when(head.isin("no contest", "nc"), "no_contest").when(head == "draw", "draw")
    kind = F.when(method == "decision", F.when(F.lower(detail).isin("unanimous", "split", "majority"), F.lower(detail)))
    return F.struct(method.alias("method"), kind.alias("decision_type"), F.when(kind.isNull(), detail).alias("detail"))


def bout_checks(definition: Column, outcome: Column, round_no: Column) -> Column:
    """Names of rules that a bout from a results table breaks: ``def.`` stands for a win, rounds are 1 to 5."""
    bad = F.array(F.when((F.lower(F.trim(definition)).isin("def.", "def")) != (outcome == "win"), F.lit("def_means_win")), F.when(~round_no.between(1, 5), F.lit("round_range")))
    return F.filter(bad, lambda x: x.isNotNull())


def load_report(rows: DataFrame, name: str, entity: str, day: str, top: int = 80) -> tuple[DataFrame, DataFrame]:
    """(summary, unmatched): counts and range of a load, and the unmatched names with most rows (a report's top list)."""
    lost = F.col(entity).isNull()
    s = rows.agg(F.count("*").alias("rows"), F.count_if(~lost).alias("matched"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.round(F.try_divide(F.count_if(lost) * 100, F.count("*")), 1).alias("unmatched_pct"))
    return s, rows.where(lost).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(top)
