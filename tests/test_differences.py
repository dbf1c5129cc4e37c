from datetime import date

from tallyspan.operators import differences as d

S = "k long, a string, b long, field string"


def cells(spark, left, right, **kw):
    out = d.differences(spark.createDataFrame(left, S), spark.createDataFrame(right, S), "k", ["a", "b"], **kw)
    return {tuple(r) for r in out.collect()}


def test_cells(spark):
    left = [(1, "x", 1, ""), (2, None, 2, ""), (3, "z", None, ""), (4, "only", 4, ""), (None, "n", 0, "")]
    right = [(1, "y", 1, ""), (2, None, 3, ""), (3, None, 5, ""), (5, "new", 5, ""), (None, "m", 0, "")]
    got = cells(spark, left, right)
    assert got == {(1, "a", "x", "y"), (2, "b", "2", "3"), (3, "a", "z", None), (3, "b", None, "5"), (4, "missing_right", None, None), (5, "missing_left", None, None)}
    assert cells(spark, left, right, silent_nulls=True) == {c for c in got if c[0] != 3}


def test_repeats_empty_and_self(spark):
    left = [(1, "x", 1, ""), (1, "y", 1, "")]
    assert cells(spark, left, [(1, "x", 1, "")]) == {(1, "a", "y", "x")}
    assert cells(spark, left, []) == {(1, "missing_right", None, None)}
    assert cells(spark, [], left) == {(1, "missing_left", None, None)} and cells(spark, [], []) == set()
    t = spark.createDataFrame(left[:1] + [(2, "q" * 100_000, None, "")], S)
    assert d.differences(t, t, "k", ["a", "b"]).count() == 0


def test_brute_force(spark):
    import random

    rng = random.Random(2)
    mk = lambda: {k: (rng.choice([None, "p", "q"]), rng.choice([None, 1, 2])) for k in rng.sample(range(60), 40)}
    a, b = mk(), mk()
    want = {(k, "missing_right") for k in a.keys() - b.keys()} | {(k, "missing_left") for k in b.keys() - a.keys()} | {(k, f) for k in a.keys() & b.keys() for i, f in enumerate("ab") if a[k][i] != b[k][i]}
    got = cells(spark, [(k, *v, "") for k, v in a.items()], [(k, *v, "") for k, v in b.items()])
    assert {c[:2] for c in got} == want


def bouts(spark, typed, held, verdicts=()):
    people = [(1, "Ana Souza"), (2, "Bea Lima"), (3, "Caio Reis")]
    t = spark.createDataFrame(typed, "fight_id long, red_name string, blue_name string, bout_date date, winner string")
    h = spark.createDataFrame(held, "fight_id long, a long, b long, event_date date, red long, winner long, outcome string")
    v = spark.createDataFrame(list(verdicts), "event_date date, fighter_1 string, fighter_2 string, verdict string")
    return {tuple(r) for r in d.bout_differences(t, h, spark.createDataFrame(people, "id long, name string"), v).collect()}


def test_bouts(spark):
    day = date(2024, 1, 1)
    held = [(i, 1, 2, day, 1, 1, "win") for i in (1, 2, 3, 4, 5)] + [(6, 1, 2, day, None, None, "unknown"), (7, 1, 2, day, 1, None, "draw"), (8, 1, 2, None, 1, 2, "win")]
    typed = [
        (1, "Ana Souza", "Bea Lima", day, "RED "),
        (2, "LIMA, Bea", "A. Souza", day, "Blue"),  # the other corner is red, the winner the same
        (3, "Ana Souza", "Bea Lima", date(2024, 1, 2), "Draw"),
        (4, "Ana Souza", "Bea Lima", None, None),
        (6, "Bea Lima", "Ana Souza", day, "Red"),
        (7, "Ana Souza", "Bea Lima", day, "NC"),
        (8, "Ana Souza", "Bea Lima", day, "Red"),
        (9, "Ana Souza", "Bea Lima", day, "Red"),
        (None, "Ana Souza", "Bea Lima", day, "Red"),
    ]
    typed += typed[:2]
    assert bouts(spark, typed, held) == {(2, "red"), (3, "winner"), (3, "event_date"), (5, "missing_mdabbert"), (7, "winner"), (8, "winner"), (9, "missing_fight_ref")}


def test_verdicts(spark):
    day = date(2024, 1, 1)
    held = [(1, 1, 2, day, 1, 1, "win"), (2, 1, 3, day, 1, 1, "win"), (3, 2, 3, day, 2, 2, "win")]
    typed = [(1, "Ana  Souza", "Bea Lima", day, "Red"), (2, "Ana Souza", "Caio Reis", day, "Blue"), (3, "Bea Lima", "Caio Reis", day, "Red")]
    said = [(day, "bea LIMA", "anasouza", "wrong in mdabbert"), (day, "Caio Reis", "Ana Souza", "Copies agree"), (day, "Bea Lima", "Caio Reis", "unresolved"), (day, "Bea Lima", "Caio Reis", None), (date(2024, 1, 5), "Bea Lima", "Caio Reis", "both wrong")]
    assert bouts(spark, typed, held, said) == {(1, "verdict"), (2, "winner"), (2, "verdict")}
    assert bouts(spark, [], [], said) == set()
