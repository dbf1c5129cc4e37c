import random

import pytest

from tallyspan.llm import pack


def check(spark, sizes, capacity):
    d = spark.createDataFrame([(k, n, 0) for k, n in sizes], "id long, n long, container_id long")
    out = pack.pack(d, "id", "n", capacity).collect()
    want = {k: n for k, n in sizes if n}
    covered, used = {}, {}
    for r in out:
        covered.setdefault(r.id, []).append((r.begin, r.length))
        used.setdefault(r.container_id, []).append((r["at"], r.length))
    for k, n in want.items():
        assert sum(x for _, x in covered[k]) == n and len(covered[k]) == (1 if n <= capacity else -(-n // capacity))
        assert sorted(b for b, _ in covered[k]) == [i * capacity for i in range(len(covered[k]))]
    assert covered.keys() == want.keys()
    for places in used.values():
        end = 0
        for at, length in sorted(places):
            assert at == end  # no overlap, no hole
            end += length
        assert end <= capacity
    total = sum(want.values())
    return len(used), -(-total // capacity)


def test_many_short(spark):
    rng = random.Random(3)
    sizes = [(i, int(min(5000, rng.expovariate(1 / 120)) + 1)) for i in range(3000)]
    n, least = check(spark, sizes, 2048)
    assert n <= least * 1.01 + 1


@pytest.mark.parametrize("seed", range(2))
def test_hard_sizes(spark, seed):
    rng = random.Random(seed)
    n, least = check(spark, [(i, rng.randint(300, 700)) for i in range(600)], 1000)
    assert n <= least * 1.2 + 1


def test_hot_length_and_edges(spark):
    n, least = check(spark, [(i, 64) for i in range(900)] + [(1000, 2048), (1001, 4096), (1002, 5000)], 2048)
    assert n == least
    assert check(spark, [(1, 1)], 1) == (1, 1)
    assert check(spark, [(1, None), (2, 0)], 8) == (0, 0)
    assert check(spark, [], 8) == (0, 0)
    with pytest.raises(ValueError):
        pack.pack(spark.range(1).selectExpr("id", "id n"), "id", "n", 0)
