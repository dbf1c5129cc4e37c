from datetime import date

from pyspark.sql import functions as F

from tallyspan.operators import identity as i


def test_events_and_entities(spark):
    inc = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "article_id long")
    link = spark.createDataFrame([(1, 10), (4, 40)], "article_id long, event_id long")
    mem = spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, 30), (3, 31), (4, 41)], "article_id long, event_id long")
    got = {r.article_id: (r.event_id, r.status) for r in i.resolve_events(inc, link, mem).collect()}
    assert got == {1: (10, "linked"), 2: (20, "matched"), 3: (None, "collision"), 4: (None, "collision"), 5: (None, "create")}
    t = spark.createDataFrame([(x,) for x in "abcde"], "title string")
    links = spark.createDataFrame([("a", 1)], "title string, entity long")
    names = spark.createDataFrame([("b", 2, "name"), ("c", None, "ambiguous")], "title string, entity long, name_status string")
    out = {r.title: (r.entity, r.status) for r in i.resolve_entities(t, links, names, spark.createDataFrame([("d",)], "title string")).collect()}
    assert out == {"a": (1, "linked"), "b": (2, "named"), "c": (None, "ambiguous"), "d": (None, "held"), "e": (None, "stub")}


def test_small_rules(spark):
    held = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, None)], "k long, link string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (4, "y"), (1, "z")], "k long, link string")
    assert {r.k: r.link for r in i.link_if_free(held, new, "k", "link").collect()} == {1: "x", 2: None, 3: "y", 4: None}
    d = spark.createDataFrame([(1, "scheduled", "unknown", "win"), (1, "completed", "draw", "win"), (2, "scheduled", "unknown", None)], "e long, status string, o string, n string")
    out = i.cancel_scheduled(d, "e", [1]).withColumn("o", i.fill_unknown(F.col("o"), F.col("n"))).collect()
    assert [(r.status, r.o) for r in out] == [("cancelled", "win"), ("completed", "draw"), ("scheduled", "unknown")]
    s = spark.createDataFrame([((1, None, 3), (2, 5, None))], "a struct<x:int,y:int,z:int>, b struct<x:int,y:int,z:int>")
    assert s.select(i.known_differences("a", "b", ["x", "y", "z"], ["z"]).alias("d")).first().d == ["x", "z"]
    q = spark.createDataFrame([(None, "L", "L", True), (None, "L", "M", False), ("H", None, None, None)], "r string, a string, b string, t boolean")
    got = q.select(i.resolve_class(F.col("r"), F.col("a"), F.col("b")).alias("c"), i.default_rounds(F.lit(None).cast("int"), F.col("t")).alias("n")).collect()
    assert [(r.c.weight_class, r.c.status, r.n) for r in got] == [("L", "recent", 5), (None, "classes differ: L and M", 3), ("H", "requested", 3)]


def test_texts(spark):
    d = spark.createDataFrame([("Women's Flyweight Title Bout",), ("Catch weight (195 lb)",), ("Light Heavyweight",), ("Odd",)], "x string")
    got = [tuple(r.c) for r in d.select(i.class_lookup(F.col("x")).alias("c")).collect()]
    assert got == [("Women's Flyweight", True, True, "division"), ("Catch Weight", False, False, "catch"), ("Light Heavyweight", False, False, "division"), (None, False, False, None)]
    m = spark.createDataFrame([("Submission (rear naked choke)",), ("Decision (Split)",), ("TKO (punches)",), ("Magic",)], "x string")
    assert [tuple(r.c) for r in m.select(i.method_text(F.col("x")).alias("c")).collect()] == [("submission", None, "rear naked choke"), ("decision", "split", None), ("ko_tko", None, "punches"), (None, None, None)]
    b = spark.createDataFrame([("def.", "win", 3), ("vs.", "win", 6), ("def.", "draw", 1)], "d string, o string, r int")
    assert [r.c for r in b.select(i.bout_checks(F.col("d"), F.col("o"), F.col("r")).alias("c")).collect()] == [[], ["def_means_win", "round_range"], ["def_means_win"]]
    p = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    assert [r.v for r in p.select(i.ratio(F.col("a"), F.col("b")).alias("v")).collect()] == [0.75, 1.0, None]
    o = spark.createDataFrame([(5, 5, "q", "x", "y"), (None, 5, "Ana Sousa", "Bo", "Ana Souza"), (None, 5, "x", "x", "y")], "f long, a long, n string, an string, bn string")
    assert [r.v for r in o.select(i.orient_first(*(F.col(c) for c in ("f", "a", "n", "an", "bn"))).alias("v")).collect()] == [True, False, True]


def test_reports(spark):
    r = spark.createDataFrame([("a", 1, date(2024, 1, 1)), ("b", None, date(2024, 1, 3)), ("b", None, None)], "n string, e long, d date")
    s, lost = i.load_report(r, "n", "e", "d")
    assert s.first().asDict() == {"rows": 3, "matched": 1, "first_day": date(2024, 1, 1), "last_day": date(2024, 1, 3), "unmatched_pct": 66.7}
    assert [tuple(x) for x in lost.collect()] == [("b", 2)]
    assert [x.json for x in i.golden_rows(spark.createDataFrame([(2, None), (1, "q")], "k int, a string"), ["k"]).collect()] == ['{"a":"q","k":1}', '{"a":null,"k":2}']
    t = spark.createDataFrame([("event", "completed", date(2024, 1, 1)), ("event", "scheduled", date(2024, 1, 1)), ("list", None, None)], "k string, s string, d date")
    assert [x.v for x in t.select(i.cache_ttl(F.col("k"), F.col("s"), F.col("d"), F.lit("2024-02-01").cast("date")).alias("v")).collect()] == [None, 3600, 21600]
    q = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 2), 1.0, None)], "u date, b date, x double, y double")
    v = q.select(i.quality(F.col("u"), F.col("b"), [F.col("x"), F.col("y")]).alias("v")).first().v
    assert (v.current, v.complete, v.note) == (False, False, "features are older than the latest bout; some rates are unknown")
