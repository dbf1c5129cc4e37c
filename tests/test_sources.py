from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyspan.functions import domain, net, text
from tallyspan.functions.names import fold_column, similarity, tokens
from tallyspan.sources import files, pages


def values(spark, col, data, kind="string"):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r.y for r in d.select("i", col(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, text.clean_text, ["  a   b ", "", "NULL", None]) == ["a b", None, None, None]
    assert values(spark, text.optional_text, ["--", "x", None]) == [None, "x", None]
    assert values(spark, text.parse_int, ["12", " ", "--"]) == [12, None, None]
    with pytest.raises(Exception, match="not an integer"):
        values(spark, text.parse_int, ["1x"])
    assert [tuple(x) if x else x for x in values(spark, text.parse_of, ["3 of 7", "0 of 0", "---"])] == [(3, 7), (0, 0), None]
    assert values(spark, text.clock_seconds, ["4:59", "5:60", None]) == [299, None, None]
    assert values(spark, text.height_cm, ["5' 11\"", "--"]) == [180.34, None]
    assert values(spark, text.inches_cm, ['72"', "x"]) == [182.88, None]
    assert values(spark, text.long_date, ["January 5, 2024", "Sept. 5, 2024", "Feb 30, 2024"]) == [date(2024, 1, 5), date(2024, 9, 5), None]
    assert values(spark, text.slug, ["A b/C", "!!", None]) == ["a-b-c", "auto", "auto"]
    assert values(spark, text.strict_id, ["http://x/0123456789abcdef/", "http://x/zz"]) == ["0123456789abcdef", None]
    assert values(spark, lambda c: text.canonical_url(c, ["a.example"]), ["HTTPS://www.A.example/x/#f", "http://b.example/x"]) == ["http://a.example/x", None]
    assert values(spark, text.article_title, ["/wiki/Jos%C3%A9_A", "/wiki/File:x", "/w/index.php?redlink=1"]) == ["José A", None, None]
    assert values(spark, text.escape_like, ["5%_\\"]) == ["5\\%\\_\\\\"]
    assert values(spark, text.strip_markers, ["Ana B (c) [4]"]) == ["Ana B"] and values(spark, text.note_kind, ["BMF championship", "title", "x"]) == ["bmf", "championship", None]
    assert values(spark, text.scheduled_rounds, ["5 Rnd (5-5-5-5-5)", "No"]) == [5, None] and values(spark, text.tolerant_double, ["1.5", "nan", "x"]) == [1.5, None, None]
    assert [tuple(x) for x in values(spark, text.split_location, ["X", "C, X", "A, B, S, X"])] == [(None, None, "X"), ("C", None, "X"), ("A, B", "S", "X")]


def test_domain(spark):
    assert [tuple(x) if x else x for x in values(spark, domain.result_method, ["KO/TKO", "Decision - Split ", None])] == [("ko_tko", None), ("decision", "split"), None]
    with pytest.raises(Exception, match="unknown result"):
        values(spark, domain.result_method, ["Magic"])
    assert values(spark, lambda c: domain.result_method(c, lenient=True), ["Magic"]) == [None]
    assert values(spark, domain.stance, ["Orthodox ", "", "Sideways", None]) == ["orthodox", "unknown", "other", "unknown"]
    assert values(spark, domain.moneyline_decimal, [150.0, -200.0], "double") == [2.5, 1.5]
    with pytest.raises(Exception, match="moneyline of 0"):
        values(spark, domain.moneyline_decimal, [0.0], "double")
    assert values(spark, lambda c: domain.vocabulary_code(c, ["a", "b", "other"]), ["b", "z", None]) == [1, 2, None]
    assert values(spark, lambda c: domain.outcome_of_badges(c, F.lit("L")), ["W", "D"]) == ["win", None]
    assert values(spark, domain.retry_after, ["5", "99999", "-1", None]) == [5, 3600, 60, 60]
    assert values(spark, lambda c: domain.whole_years(c, F.lit("2023-02-28").cast("date")), [date(2000, 2, 29), date(2000, 2, 28)], "date") == [22, 23]
    assert [tuple(x) for x in values(spark, domain.error_disposition, ["ServerTimeout", "ParseError", "Odd"])] == [(True, "transient"), (False, "unreadable"), (False, "unexpected")]
    d = spark.createDataFrame([(1, 1.0), (0, 0.5), (0, 0.0)], "y int, p double")
    r = d.agg(domain.accuracy(F.col("y"), F.col("p")).alias("a"), domain.log_loss(F.col("y"), F.col("p")).alias("l"), domain.brier(F.col("y"), F.col("p")).alias("b")).first()
    assert r.a == 1.0 and 0.23 < r.l < 0.24 and abs(r.b - 0.25 / 3) < 1e-12


def test_names(spark):
    assert values(spark, fold_column, ["Łukasz  Ødegård-Æbø", "Mônica D'Ávila", None, ""]) == ["lukasz odegard aebo", "monica davila", None, ""]
    assert tokens('Last, First "Nick" (W)') == ("first", "last")
    assert similarity(None, "a") == similarity("", "a") == 0 and similarity("Ana Souza", "SOUZA, Ana") > 0.95
    assert similarity("N. Souza", "Nils Souza") > 0.8 > 0.5 > similarity("Nils Souza", "Nils Perkovic")
    assert similarity("Nils Souza", "Nils Souza Jr.") < similarity("Nils Souza", "Nils Souza")


def test_net():
    assert net.client_of("10.0.0.1", "1.2.3.4, 10.0.0.9", ["10.0.0.0/8"]) == "1.2.3.4"
    assert net.client_of("9.9.9.9", "1.2.3.4", ["10.0.0.0/8"]) == "9.9.9.9"
    assert net.bucket_of("::ffff:1.2.3.4") == "1.2.3.4" and net.bucket_of("2001:db8::1") == "2001:db8::/64" and net.bucket_of("x") is None


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("date,weightclass,fighter,rank\n2024-01-01,L,NA,0\n2024-01-01,L,,0\n2024-01-01,L,Ana,1\n")
    (tmp_path / "a.csv").write_text("source,alias,ufcstats_id,note\ns,An,1,\ns,Bo,9,\n")
    (tmp_path / "o.csv").write_text("R_fighter,B_fighter,date,R_odds,B_odds,Winner,weight_class\nA, B ,2024-01-01,-150,nan,Red,L\n")
    (tmp_path / "f.csv").write_text("fight_url,fighter_1,fighter_2,odds_1,odds_2,event_date,adding_date,source,region\n,A,B,1.5,,2024-01-01,2023-12-31T10:00:00,s,uk\n")
    rows, vacant = files.read_rankings(spark, str(tmp_path / "r.csv"))
    assert rows.count() == 1 and vacant.count() == 2
    with pytest.raises(files.BadFile, match="9"):
        files.read_aliases(spark, str(tmp_path / "a.csv"), spark.createDataFrame([("1",)], "ufcstats_id string"))
    o = files.read_odds(spark, str(tmp_path / "o.csv")).first()
    assert (o.blue_name, o.red_odds, o.blue_odds, o.bout_date) == ("B", -150.0, None, date(2024, 1, 1))
    f = files.read_feed(spark, str(tmp_path / "f.csv")).first()
    assert (f.fight_url, f.odds_2) == (None, None) and f.added.hour == 10
    m = files.build_manifest(spark, str(tmp_path)).cache()
    assert m.count() == 4 and files.verify_files(spark, str(tmp_path), m).count() == 4
    again = files.build_manifest(spark, str(tmp_path), m.withColumn("downloaded_at", F.lit("2020-01-01").cast("timestamp")))
    assert {r.downloaded_at.year for r in again.collect()} == {2020}
    (tmp_path / "new.csv").write_text("x")
    with pytest.raises(files.BadFile, match="unlisted"):
        files.verify_files(spark, str(tmp_path), m)


def test_wide_metrics_redirects(spark, tmp_path):
    w = spark.createDataFrame([("x", 1.0, float("nan"), 2.0)], "k string, f_1_r1_kd double, f_1_r2_kd double, f_2_r1_td_landed double")
    got = {(r.side, r["round"]): (r.kd, r.td_landed) for r in files.unpivot_wide(w, "k").collect()}
    assert got == {("f_1", 1): (1, None), ("f_2", 1): (None, 2)}
    (tmp_path / "m.txt").write_text('# HELP x\nreq_total{a="1",b="x y"} 5\nlat_bucket{le="+Inf"} 7\nup 1\n')
    s = {r.name: (r.labels, r["sample"]) for r in files.metric_samples(spark, str(tmp_path / "m.txt")).collect()}
    assert s["req_total"] == ({"a": "1", "b": "x y"}, 5.0) and s["up"] == ({}, 1.0)
    p = spark.createDataFrame([("a",), ("d",), ("l",)], "url string")
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("l", "l")], "from_url string, to_url string")
    assert {x.url: (x.target, x.hops) for x in files.follow_redirects(p, r).collect()} == {"a": ("c", 2), "d": ("d", 0), "l": (None, 3)}
    assert files.synthetic_events(spark, 60, "2024-12-30", "t").agg(F.countDistinct("event_id"), F.max("page")).first()[0:2] == (60, 3)


PAGE = """<!-- url: http://x/list --><html><title>T</title><body><table><tr><th>Name/date</th><th>Location</th></tr>
<tr><td><a href="http://x/event-details/0123456789abcdef">Card &amp; One</a> January 6, 2024</td><td> City,  X </td></tr><tr><td>short</td></tr></table>
<script>var c={"wgArticleId": 5, "wgRevisionId": 9}</script></body></html>"""


def test_pages(spark, tmp_path):
    (tmp_path / "list_1.html").write_text(PAGE)
    (tmp_path / "odd.html").write_text("<p>none")
    pages.register(spark)
    p = spark.read.format("saved_pages").load(str(tmp_path))
    assert {r.url for r in p.collect()} == {"http://x/list", "odd.html"}
    (e,) = pages.event_list(p).collect()
    assert (e.event_id, e.name, e.event_date, e.location) == ("0123456789abcdef", "Card & One", date(2024, 1, 6), "City, X")
    _, errors = pages.checked_tables(pages.page_tables(p), "url", ["name/date"])
    assert [r.error for r in errors.collect()] == ["layout:row 2"]
    _, lost = pages.checked_tables(pages.page_tables(p), "url", ["other"])
    assert "layout:no table" in {r.error for r in lost.collect()}
    assert p.where("kind = 'list'").select(pages.page_ids(F.col("html")).alias("i")).first().i == (5, 9)
    pages.register_functions(spark)
    p.createOrReplaceTempView("saved")
    assert spark.sql("SELECT t.* FROM saved, LATERAL html_table_rows(html) t").count() == 3
    small = pages.minimise(PAGE)
    assert "script" not in small and pages.table_rows(small) == pages.table_rows(PAGE)
    assert pages.crawl_delay("User-agent: *\nCrawl-delay: 5\nUser-agent: bot\nCrawl-delay: 0.5", "mybot") == 0.5
    with pytest.raises(ValueError):
        pages.json_strict({"a": float("nan")})


def test_event_and_fighter_pages(spark):
    a, b, f = "0123456789abcdef", "fedcba9876543210", "00112233445566aa"
    event = f"""<table><tr><th>W/L</th><th>Fighter</th><th>Weight class</th><th>Method</th><th>Round</th><th>Time</th></tr>
<tr><td><a href="http://x/fight-details/{f}">win</a></td><td><a href="http://x/fighter-details/{a}">Ana B</a><a href="http://x/fighter-details/{b}">Caio D</a></td><td>Flyweight</td><td>KO/TKO</td><td>2</td><td>4:05</td></tr>
<tr><td></td><td>to be announced</td><td>--</td><td>--</td><td>--</td><td>--</td></tr></table>"""
    bio = "<ul><li><i>Height:</i> 5' 11&quot;</li><li>Reach: --</li><li>STANCE: Southpaw</li><li>DOB: Jan. 5, 1990</li><li>SLpM: 3.1</li></ul>".replace("&quot;", '"')
    d = spark.createDataFrame([("http://x/event-details/1", event)], "url string, html string")
    (r,) = pages.event_bouts(d).collect()
    assert tuple(r) == ("http://x/event-details/1", 1, f, a, b, "win", "Flyweight", "KO/TKO", 2, 245)
    (x,) = pages.fighter_bio(spark.createDataFrame([(f"http://x/fighter-details/{a}", bio)], "url string, html string")).collect()
    assert (x.fighter_id, x.height_cm, x.reach_cm, x.stance, x.dob) == (a, 180.34, None, "Southpaw", date(1990, 1, 5))
    assert pages.is_block_page(F.lit("<p>Just a moment...")) is not None
