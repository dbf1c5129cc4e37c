from datetime import date, datetime

from pyspark.sql import functions as F

from tallyspan.llm import survive

DAY = date(2024, 1, 1)


def run(spark, fights, events=((1, DAY), (2, date(2024, 1, 2)), (3, date(2024, 2, 1)), (4, None))):
    f = spark.createDataFrame([(*x, "clash") for x in fights], "id long, event_id long, fighter_a_id long, fighter_b_id long, result_source string, outcome string, winner_id long, loaded_at timestamp, day string")
    e = spark.createDataFrame(list(events), "id long, event_date date")
    return {tuple(r) for r in survive.surviving_bouts(f, e).collect()}


def at(h):
    return datetime(2024, 1, 5, h)


def test_fields_and_ranks(spark):
    rows = [
        (1, 1, 10, 11, "wikipedia", "Draw", None, at(5)),
        (2, 2, 11, 10, "ufcstats", None, None, at(1)),
        (3, 1, 10, 11, "ufcstats", " WIN ", 99, at(3)),  # knows the outcome, not the winner
        (4, 1, 10, 11, "ufcstats", "win", 11, at(2)),
        (5, 3, 10, 11, "ufcstats", "win", 10, at(2)),  # another bout of the pair
        (6, 1, 12, 13, "ufcstats", "NC", None, None),
        (7, 1, 12, 13, "ufcstats", "win", 12, None),  # ties: the smaller id counts first
        (8, 1, 14, 15, None, "odd", 14, at(1)),
        (9, 1, 14, 15, None, None, None, at(1)),
        (10, 1, 16, 17, "ufcstats", "win", None, at(1)),
        (11, 1, 16, 17, None, "draw", None, at(9)),
        (12, 4, 18, 19, "ufcstats", "win", 18, at(1)),
        (13, 4, 18, 19, "ufcstats", "win", 18, at(1)),
        (14, 1, None, 19, "ufcstats", "win", 18, at(1)),
    ]
    assert run(spark, rows) == {(1, "win", 11), (6, "no_contest", 0), (8, "unknown", 0), (10, "win", 0)}
    assert run(spark, []) == set() and run(spark, rows, []) == set()


def test_a_day_apart(spark):
    rows = [(1, 1, 1, 2, None, "draw", None, None), (2, 2, 2, 1, None, None, None, None), (3, 2, 2, 1, None, None, None, None)]
    assert run(spark, rows) == {(1, "draw", 0)}


def test_generic_survivors(spark):
    d = spark.createDataFrame([("g", 1, "a", None), ("g", 2, None, 5), ("g", 2, "", 7), (None, 1, None, None)], "k string, t int, x string, y int")
    out = {r.k: r for r in survive.survivors(d, ["k"], {"x": F.nullif("x", F.lit("")), "y": F.col("y")}, [F.col("t")]).collect()}
    assert (out["g"].x, out["g"].y) == ("a", 7) and out[None].x is None
