import random
from datetime import date, datetime, timedelta

from tallyspan.operators import bitemporal as b


def test_versions_stay_whole():
    rng, roots, states, root, state = random.Random(1), [], [], None, {}
    for _ in range(400):
        k, v = rng.randrange(60), rng.random()
        root, state = b.insert(root, k, v), state | {k: v}
        roots.append(root)
        states.append(state)
    for root, state in zip(roots[::17], states[::17], strict=True):
        for k in range(-1, 62):
            hit, low = b.find(root, k), b.before(root, k)
            assert (hit[2] if hit else None) == state.get(k)
            want = max((x for x in state if x < k), default=None)
            assert (low[0] if low else None) == want


def world(spark, rankings, features=((1, 10, "L"),)):
    ff = spark.createDataFrame([(*f, "clash") for f in features], "fight_id long, fighter_id long, weight_class string, source string")
    fi = spark.createDataFrame([(1, 5), (2, None)], "id long, event_id long")
    ev = spark.createDataFrame([(5, 7, date(2024, 1, 10))], "id long, circuit_id long, event_date date")
    rk = spark.createDataFrame(rankings, "circuit_id long, source string, snapshot_date date, ranking_type string, weight_class string, fighter_id long, rank short, loaded_at timestamp")
    return b.rank_as_known(ff, fi, ev, rk)


def row(days_before, fighter=10, rank=3, loaded=None, source="s", circuit=7, kind="division", wc="L"):
    d = date(2024, 1, 10) - timedelta(days=days_before)
    return (circuit, source, d, kind, wc, fighter, rank, loaded or datetime(d.year, d.month, d.day, 12))


def test_known_before_the_day(spark):
    at = lambda h: datetime(2024, 1, h)
    rows = [
        row(9, rank=1),
        row(5, rank=2),
        row(5, rank=4, loaded=at(6)),  # a later correction
        row(5, rank=9, loaded=at(10)),  # known on the day only
        row(0, rank=5),  # dated on the day
        row(2, fighter=11, rank=1, source="t"),  # newest list of t lacks the fighter
        row(3, rank=7, source="t"),
        row(4, rank=1, source="u", kind="p4p"),
        row(4, rank=1, source="v", circuit=8),
        row(3, rank=None, source="w"),
        row(3, fighter=None, rank=1, source="x"),
        row(6, rank=1, source="x"),
        row(3, rank=2, source="y"),
        row(3, rank=2, source="y"),
        row(3, rank=6, source="z", loaded=at(9)),
        row(3, rank=5, source="z", loaded=at(9)),  # a tie in time: the smaller rank
    ]
    got = {(r.source, r["rank"]) for r in world(spark, rows).collect()}
    assert got == {("s", 4), ("w", None), ("y", 2), ("z", 5)}


def test_nulls_repeats_and_empty(spark):
    features = [(1, 10, "L"), (1, 10, "L"), (1, None, "L"), (1, 10, None), (2, 10, "L"), (99, 10, "L")]
    nulls = [(7, "s", None, "division", "L", 10, 1, datetime(2024, 1, 1)), (7, "s", date(2024, 1, 1), "division", "L", 10, 1, None)]
    assert world(spark, nulls, features).count() == 0
    assert world(spark, [], features).count() == 0
    assert world(spark, [row(3)], features).count() == 1
