import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspan.ml import training as ml
from tallyspan.operators.lineage import Builds, IncompleteBuild

NAMES = ["x", "y"]


@pytest.fixture(scope="module")
def league(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        ax, bx = rng.random(), rng.random()
        rows.append((i, date(2022, 1, 1) + timedelta(i * 2), ax, bx, None if i % 9 == 0 else rng.random(), rng.random(), float(rng.random() < 1 / (1 + 2.718 ** (-5 * (ax - bx)))), i % 3))
    return spark.createDataFrame(rows, "id long, day date, a_x double, b_x double, a_y double, b_y double, label double, method int").cache()


def test_split_and_leak(league):
    d = ml.time_split(league, "day", 200, 200)
    ml.assert_no_leak(d, "day")
    assert {r["split"] for r in d.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):
        ml.assert_no_leak(d.withColumn("split", F.when(F.col("id") == 399, "train").otherwise(F.col("split"))), "day")


def test_symmetry_bundle_registry(spark, league, tmp_path):
    d = ml.time_split(league, "day", 200, 200)
    m = ml.fit_win(ml.swap_sides(d, "id", ["a_x", "a_y"], ["b_x", "b_y"], "label", 3), NAMES, "label", trees=10)
    p = {r.id: r.p for r in m.score(d).collect()}
    q = {r.id: r.p for r in m.score(ml.flipped(d, NAMES)).collect()}
    assert max(abs(p[i] + q[i] - 1) for i in p) < 1e-12
    s = {r.model: r for r in ml.score_block(m.score(d.where("split = 'test'")), "label", {"model": F.col("p"), "coin": F.lit(0.5)}).collect()}
    assert s["model"].log_loss < s["coin"].log_loss and s["coin"].accuracy is None
    ml.write_bundle(str(tmp_path / "b"), m, {"seed": 3})
    again = ml.load_bundle(str(tmp_path / "b"), NAMES)
    assert {r.id: r.p for r in again.score(d).collect()} == p
    with pytest.raises(ValueError):
        ml.load_bundle(str(tmp_path / "b"), ["x"])
    r = ml.Registry(spark, str(tmp_path / "reg"))
    r.register("v1", {"ll": 1.0})
    r.register("v2", {"ll": 0.5})
    r.activate("v1")
    r.activate("v2")
    assert r.active() == "v2" and r.list().count() == 2
    with pytest.raises(ValueError):
        r.register("v1", {})
    with pytest.raises(ValueError):
        r.activate("v9")


def test_contributions_bootstrap_method(league):
    c = ml.linear_contributions(league, NAMES, "label", "id")
    f = ml.linear_contributions(ml.flipped(league, NAMES).withColumn("label", 1 - F.col("label")), NAMES, "label", "id")
    a, b = ({(r.id, r.feature): r.phi for r in x.collect()} for x in (c, f))
    assert max(abs(a[k] + b[k]) for k in a) < 1e-6
    assert ml.top_contributions(c, "id", 1).groupBy("id").count().agg(F.max("count")).first()[0] == 1
    mean, low, high = ml.bootstrap_difference(league, "id", F.col("a_x"), F.col("b_x"), 200)
    assert low < mean < high and ml.bootstrap_difference(league, "id", F.col("a_x"), F.col("b_x"), 200) == (mean, low, high)
    m, cols = ml.fit_method(league.withColumn("method", F.col("method").cast("double")), NAMES, "method")
    assert m.numClasses == 3 and all(c.startswith(("mean_", "gap_")) for c in cols)
    assert ml.vocabulary(league.select(F.col("method").cast("string").alias("m")), ["m"], 134) == ["0", "other"]


def test_freshness_and_builds(spark, tmp_path):
    facts = spark.createDataFrame([(1,), (2,)], "k long")
    rows = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b"), (2, "b")], "k long, build string")
    ml.freshness(rows, facts, "k", "build", 2, "f", "f")
    for bad, fp in ((rows.limit(3), "f"), (rows, "g")):
        with pytest.raises(ValueError):
            ml.freshness(bad, facts, "k", "build", 2, fp, "f")
    b = Builds(spark, str(tmp_path / "t"))
    b.publish(rows, ["k"], 2, facts, note="first")
    with pytest.raises(IncompleteBuild):
        b.publish(rows.limit(3), ["k"], 2, facts)
    assert b.current().count() == 4 and b.runs().count() == 1
