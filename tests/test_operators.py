from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import aggregate, asof, limits, matching, merge, pit, sides

D = date(2024, 1, 1)


def career(spark, rows):
    d = spark.createDataFrame(rows, "e long, day date, id long, x long, r string")
    out = pit.career(d, "e", "day", n=F.count("*"), s=F.sum("x"))
    out = pit.trailing(out, "e", "day", "id", 2, s2=F.sum("x"), n2=F.count("*"))
    out = pit.streak(out, "e", "day", "id", F.col("r"))
    return {r.id: (r.n, r.s, r.s2, r.n2, r.streak) for r in out.collect()}


def test_history_is_strictly_before(spark):
    rows = [(1, D + timedelta(k // 2), k, k if k != 3 else None, "win") for k in range(8)] + [(2, D, 100, 5, "stop"), (2, None, 101, 1, "win"), (None, D, 102, 1, "win")]
    got = career(spark, rows)
    assert got[0] == got[1] == (0, None, None, 0, 0)
    assert got[4] == got[5] == (4, 3, 2, 2, 4)  # a row without value uses up its place
    # Rewriting the future leaves the past as it is, and changes what comes later.
    later = [(e, d, i, (x if i < 4 else 1000), r if i < 4 else "stop") for e, d, i, x, r in rows]
    again = career(spark, later)
    assert all(again[i] == got[i] for i in range(6)) and again[7] != got[7]
    assert career(spark, list(reversed(rows))) == got
    assert career(spark, []) == {}


def test_split_career_is_career(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), D + timedelta(rng.randrange(400)) if rng.random() < 0.95 else None, i, rng.choice([None, 1, 5, 9])) for i in range(300)]
    d = spark.createDataFrame(rows, "e long, day date, id long, x long").where("e is not null and day is not null")
    a = pit.career(d, "e", "day", n=F.sum(F.lit(1)), s=F.sum("x"), m=F.max("x"))
    b = pit.career_split(d, "e", "day", sums={"n": F.lit(1), "s": F.col("x")}, highs={"m": F.col("x")}, span_days=30)
    key = lambda z: sorted(((r.id, r.n, r.s, r.m) for r in z.collect()), key=lambda t: t[0])
    assert [tuple(x) for x in key(a)] == [tuple(x) for x in key(b)]
    odd = spark.createDataFrame([(None, D, 1, 1), (1, None, 2, 1)], "e long, day date, id long, x long")
    assert {(r.s, r.m) for r in pit.career_split(odd, "e", "day", sums={"s": F.col("x")}, highs={"m": F.col("x")}).collect()} == {(None, None)}


def test_streak_rules(spark):
    kinds = ["win", "win", "skip", "win", "stop", "win", "unknown", "win"]
    got = career(spark, [(1, D + timedelta(i), i, 0, k) for i, k in enumerate(kinds)] + [(1, D + timedelta(9), 9, 0, "win")])
    assert [got[i][4] for i in (0, 1, 2, 3, 4, 5, 6, 7, 9)] == [0, 1, 2, 2, 3, 0, 1, None, None]


def test_duration_reasons(spark):
    cases = [(3, 1, 100, "ko_tko", 100, None), (3, 3, 300, "decision", 900, None), (3, 2, 300, "decision", None, "decision_before_the_end"), (3, None, 1, "x", None, "no_finish_time"), (3, 4, 1, "x", None, "impossible_round"), (None, 1, 1, "x", None, "unknown_rounds"), (3, 1, 301, "x", None, "impossible_time")]
    d = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(cases)], "r int, f int, s int, m string, i int")
    sec, why = pit.fight_duration(*(F.col(c) for c in "rfsm"))
    assert [(r.sec, r.why) for r in d.select("i", sec.alias("sec"), why.alias("why")).orderBy("i").collect()] == [c[4:] for c in cases]


def test_policy_merge(spark):
    s = "id long, r string, f string, t boolean"
    held = spark.createDataFrame([(1, "a", "b", True), (2, "a", "b", None), (3, "a", None, False), (4, "z", "z", False)], s)
    new = spark.createDataFrame([(1, None, None, False), (2, "a", "b", None), (3, "q", "w", True), (5, "n", None, None)], s)
    out = merge.policy_merge(held, new, ["id"], replace=["r"], fill=["f"], sticky_true=["t"])
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got == {1: (None, "b", True, "updated"), 2: ("a", "b", None, "unchanged"), 3: ("q", "w", True, "updated"), 4: ("z", "z", False, "kept"), 5: ("n", None, None, "inserted")}
    again = merge.policy_merge(out.drop("action"), new, ["id"], replace=["r"], fill=["f"], sticky_true=["t"])
    assert {r.action for r in again.collect()} == {"unchanged", "kept"}
    blocked = merge.policy_merge(held, new, ["id"], replace=["r"], fill=["f"], sticky_true=["t"], only_if=F.col("held.f").isNotNull())
    assert {r.id: r.action for r in blocked.collect()}[3] == "unchanged"
    with pytest.raises(merge.DuplicateKeys):
        merge.reject_duplicates(new.union(new), ["id"])


def test_asof_statuses(spark):
    facts = spark.createDataFrame([(i, "k", 10, D) for i in range(1)] + [(1, "k", 11, D), (2, "none", 10, D), (3, "old", 10, D)], "id long, k string, e long, day date")
    snaps = [("k", D - timedelta(2), "b", 10, 5), ("k", D - timedelta(30), "a", 10, 1), ("k", D, "a", 10, 2), ("old", D - timedelta(22), "a", 10, 4)]
    out = asof.snapshot_status(facts, spark.createDataFrame(snaps, "k string, s date, src string, e long, v long"), ["k"], "day", "s", "src", {"a": 0, "b": 1}, "e", "v", 21)
    assert {r.id: (r.src, r.value, r.status) for r in out.collect()} == {0: ("b", 5, "ranked"), 1: ("b", None, "unranked"), 2: (None, None, "no_snapshot"), 3: ("a", None, "stale")}


def test_token_bucket_and_slots(spark):
    rows = [("a", i, float(t)) for i, t in enumerate([0, 0, 0, 1, 5, 5, 5, 100])] + [("b", 20, 0.0), ("b", 21, 0.1)]
    d = spark.createDataFrame(rows, "k string, i long, t double")
    got = {r.i: r.allowed for r in limits.token_bucket(d, "k", "t", "i", [(2, 0.5), (4, 0.1)]).collect()}
    assert [got[i] for i in range(8)] == [True, True, False, False, True, True, False, True] and got[20] and got[21]
    slots = limits.reserve_slots(spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 1, 2, 50, 51])], "k string, i long, t long"), "k", "t", "i", 10)
    assert [r.slot for r in slots.orderBy("i").collect()] == [0, 10, 20, 50, 60]


def test_fingerprint_and_reconcile(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    fp = lambda x: aggregate.fingerprint(x, [F.col("k"), F.col("v")]).first().fingerprint
    assert fp(d) == fp(d.orderBy(F.desc("k")).repartition(3)) != fp(d.where("k = 1"))
    held = spark.createDataFrame([("g", 1, "scheduled"), ("g", 2, "completed"), ("g", 3, "scheduled"), ("h", 4, "scheduled")], "g string, k long, status string")
    out = {r.k: (r.status, r.anomaly) for r in merge.reconcile(held, spark.createDataFrame([("g", 3)], "g string, k long"), "g", "k").collect()}
    assert out == {1: ("cancelled", None), 2: ("completed", "missing_completed"), 3: ("scheduled", None), 4: ("scheduled", None)}


def test_histogram_quantile_infinite(spark):
    b = spark.createDataFrame([("x", 1.0, 10), ("x", 2.0, 20), ("x", float("inf"), 40), ("y", 1.0, 0), ("y", float("inf"), 0)], "k string, le double, c long")
    q = lambda p: {r.k: r["quantile"] for r in aggregate.histogram_quantile(b, ["k"], "le", "c", p).collect()}
    assert q(0.25) == {"x": 1.0} and q(0.9) == {"x": 2.0} and q(0.375) == {"x": 1.5}


def test_edits_and_duplicates(spark):
    d = spark.createDataFrame([("abcd", "abdc"), ("abcd", "abc"), ("abcd", "abcd"), ("abcd", "badc"), ("", "a"), (None, "a"), ("ab", "ba")], "a string, b string")
    assert [r.x for r in d.select(matching.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False, True, None, True]
    p = spark.createDataFrame([(1, "Ana Souza"), (2, "Souza Ana"), (3, "Ana Sousa"), (4, "Ana Maria Souza"), (5, None), (6, "Bo Li")], "id long, name string")
    got = {(r.left_id, r.right_id): r.rule for r in matching.duplicate_pairs(p, "id", "name").collect()}
    assert got[1, 2] == "same_words" and got[1, 3] == "one_edit" and got[1, 4] == "surname_initial" or got[1, 4] == "subset"
    assert not any(6 in k for k in got)


def test_duplicates_are_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    base = ["michelle waterson", "michelle waterson gomez", "mizuki inoue", "mizuki", "aleksandra albukova petrov", "xaleksandra albukova petro"]
    for n in base[:1] + base[4:5]:
        for _ in range(15):
            t = list(n)
            for _ in range(rng.randint(1, 3)):
                t[rng.randrange(len(t))] = rng.choice(["", "z", "qa"])
            base.append("".join(t).strip())
    names = dict(enumerate(" ".join(n.split()) for n in base))
    got = {(r.left_id, r.right_id): r.rule for r in matching.duplicate_pairs(spark.createDataFrame(list(names.items()), "id long, name string"), "id", "name").collect()}
    assert got[0, 1] == got[2, 3] == "subset"
    for i, a in names.items():
        for j, b in names.items():
            if i < j and (set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()) or max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.9):
                assert (i, j) in got, (a, b)


def test_namesakes_by_class(spark):
    names = [(1, D, "Fly"), (2, D, "Middle"), (3, None, "Fly"), (4, D, None), (5, None, None), (6, D + timedelta(999), "Fly"), (7, D, "Heavy")]
    n = spark.createDataFrame([(i, "s", "Bo Li", d, c) for i, d, c in names], "row_id long, source string, name string, day date, weight_class string")
    act = spark.createDataFrame([(10, "Fly", D, D), (11, "Middle", D, D)], "entity long, weight_class string, first_day date, last_day date")
    people = spark.createDataFrame([(10, "Bo Li"), (11, "Bo Li"), (12, "Bo Li")], "entity long, name string")
    got = {r.row_id: (r.entity, r.status) for r in matching.resolve_names(n, people, spark.createDataFrame([], "source string, alias string, entity long"), act).collect()}
    none = (None, "ambiguous")
    assert got == {1: (10, "disambiguated"), 2: (11, "disambiguated"), 3: (10, "disambiguated"), 4: none, 5: none, 6: none, 7: none}


def test_sides(spark):
    d = spark.createDataFrame([(1, 10, 20), (2, None, 30)], "id long, a long, b long")
    assert sorted((r.id, r.entity, r.opponent) for r in sides.explode_sides(d, "a", "b").collect()) == [(1, 10, 20), (1, 20, 10), (2, 30, None)]


def test_duplicates_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Exploded keys, which Spark's estimate takes to be small, stay off the driver."""
    plans = []
    plan = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d
    monkeypatch.setattr(matching, "stored", lambda d, name: plan(d), raising=False)
    spark.createDataFrame([(1, "Ana Souza"), (2, "Ana Sousa")], "id long, name string").write.parquet(str(tmp_path / "people"))
    plan(matching.duplicate_pairs(spark.read.parquet(str(tmp_path / "people")), "id", "name"))
    assert plans and not any("Broadcast" in x for x in plans)


def test_duplicates_met_by_given_names(spark, monkeypatch):
    """Names with nothing but a given name in common are told apart before they are shuffled as pairs; close ones stay, whatever their lengths."""
    from difflib import SequenceMatcher

    shuffled = []
    distinct = type(spark.range(1)).distinct
    monkeypatch.setattr(type(spark.range(1)), "distinct", lambda d: shuffled.append(d) or distinct(d))
    families = "kerseltig mendalquor harkellund tomsevarre pebourmovi zatethinho lomnovitch gashoulhar wettulliss trasouland bradfexumi cynjopdawo".split()
    base = [f"aleksandra {x}" for x in families]
    close = [base[0][:-1] + "x", base[1] + "s", base[2] + "es", base[3].replace("tom", "tmo"), base[4].replace("eb", ""), "maria " + base[5], "maria " + base[5].replace("za", "zu"), "maria " + base[5] + "rt"]
    names = dict(enumerate(base + close))
    got = {(r.left_id, r.right_id) for r in matching.duplicate_pairs(spark.createDataFrame(list(names.items()), "id long, name string"), "id", "name").collect()}
    alike = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.9
    assert {(i, j) for i in names for j in names if i < j and alike(names[i], names[j])} <= got
    blocked = next(d for d in shuffled if set(d.columns) == {"a_id", "b_id"})
    assert distinct(blocked).count() < len(names) * (len(names) - 1) / 8
