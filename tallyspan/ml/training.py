"""Time-split training of pairwise models with exact symmetry, scores, bootstrap intervals and a registry."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.functions.domain import accuracy, brier, log_loss


def time_split(df: DataFrame, day: str, test_days: int = 365, val_days: int = 365) -> DataFrame:
    """Adds ``split``: the last ``test_days`` are test, the ``val_days`` before validation."""
    last = df.agg(F.max(day)).scalar()
    split = F.when(F.col(day) > F.date_sub(last, test_days), "test").when(F.col(day) > F.date_sub(last, test_days + val_days), "val").otherwise("train")
    return df.withColumn("split", split)


def assert_no_leak(df: DataFrame, day: str) -> None:
    """Raises if a day of one split isn't before all days of the next."""
    s = {r["split"]: (r.lo, r.hi) for r in df.groupBy("split").agg(F.min(day).alias("lo"), F.max(day).alias("hi")).collect()}
    for a, b in (("train", "val"), ("val", "test"), ("train", "test")):
        if a in s and b in s and not s[a][1] < s[b][0]:
            raise ValueError(f"{a} reaches into {b}: {s[a][1]} and {s[b][0]}")


def freshness(features: DataFrame, facts: DataFrame, key: str, build: str, expected: int, fingerprint_now: str, fingerprint_built: str) -> None:
    """Raises unless the features come from one build, are whole for every fact, and their input is unchanged."""
    builds = features.agg(F.countDistinct(build)).first()[0]
    if builds != 1:
        raise ValueError(f"features of {builds} builds")
    n = features.groupBy(key).count()
    bad = facts.select(key).join(n, key, "left").where(F.coalesce("count", F.lit(0)) != expected).count()
    if bad:
        raise ValueError(f"{bad} facts without {expected} feature rows")
    if fingerprint_now != fingerprint_built:
        raise ValueError("the features are stale: their input has changed")


def swap_sides(df: DataFrame, key: str, a: list[str], b: list[str], label: str, seed: int) -> DataFrame:
    """Rows with sides swapped by a seeded hash of the key, and the label turned with them."""
    turn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)) == 1
    cols = {x: F.when(turn, F.col(y)).otherwise(F.col(x)) for x, y in zip(a, b, strict=True)} | {y: F.when(turn, F.col(x)).otherwise(F.col(y)) for x, y in zip(a, b, strict=True)}
    return df.withColumns(cols | {label: F.when(turn, 1 - F.col(label)).otherwise(F.col(label))})


def vocabulary(df: DataFrame, columns: list[str], least: int = 30) -> list[str]:
    """Values that occur at least ``least`` times in the columns together, sorted, then ``other``."""
    n = df.select(F.explode(F.array(*columns)).alias("v")).where("v is not null").groupBy("v").count().where(F.col("count") >= least)
    return [r.v for r in n.orderBy("v").collect()] + ["other"]


def difference_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds d_x = a_x - b_x (0 where unknown) and m_x (1 where a side is unknown): both change sign or stay alike under a swap."""
    cols = {}
    for x in names:
        d = F.col(f"a_{x}").cast("double") - F.col(f"b_{x}").cast("double")
        cols[f"d_{x}"] = F.coalesce(d, F.lit(0.0))
        cols[f"m_{x}"] = d.isNull().cast("double")
    return df.withColumns(cols), list(cols)


def symmetric_features(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the mean and the absolute gap of both sides, which no swap changes."""
    cols = {}
    for x in names:
        a, b = F.col(f"a_{x}").cast("double"), F.col(f"b_{x}").cast("double")
        cols[f"mean_{x}"] = F.coalesce((a + b) / 2, a, b, F.lit(0.0))
        cols[f"gap_{x}"] = F.coalesce(F.abs(a - b), F.lit(0.0))
    return df.withColumns(cols), list(cols)


def flipped(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"a_{x}": F.col(f"b_{x}") for x in names} | {f"b_{x}": F.col(f"a_{x}") for x in names})


@dataclass
class Pairwise:
    """A win model scored in both orders, so that P(a beats b) + P(b beats a) = 1 exactly."""

    model: object
    names: list[str]

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        raw = self._raw(self._raw(df, "_ab"), "_ba", True)
        return raw.withColumn(out, (F.col("_ab") + 1 - F.col("_ba")) / 2).drop("_ab", "_ba")

    def _raw(self, df: DataFrame, out: str, turn: bool = False) -> DataFrame:
        d, cols = difference_features(flipped(df, self.names) if turn else df, self.names)
        v = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
        s = self.model.transform(v).withColumn(out, vector_to_array("probability")[1])
        keep = [c for c in df.columns]
        if turn:
            s = flipped(s, self.names)
        return s.select(*keep, out)


def fit_win(df: DataFrame, names: list[str], label: str, *, trees: int = 100, depth: int = 3, seed: int = 7) -> Pairwise:
    """Boosted trees, stopped early on rows of the split ``val`` (column ``split``)."""
    d, cols = difference_features(df, names)
    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(d.where(F.col("split").isin("train", "val")).withColumn("_val", F.col("split") == "val"))
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.1, validationIndicatorCol="_val", validationTol=0.001)
    return Pairwise(gbt.fit(v), names)


def fit_method(df: DataFrame, names: list[str], label: str, seed: int = 7) -> tuple[object, list[str]]:
    """Multiclass model on features that no swap changes."""
    d, cols = symmetric_features(df, names)
    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(d)
    return RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=50, maxDepth=5, seed=seed).fit(v), cols


def linear_contributions(df: DataFrame, names: list[str], label: str, key: str) -> DataFrame:
    """(key, feature, phi): exact additive contributions of a linear model, made antisymmetric by both orders."""
    d, cols = difference_features(df, names)
    dcols = [c for c in cols if c.startswith("d_")]
    fit = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01).fit(VectorAssembler(inputCols=dcols, outputCol="_x").transform(d))
    w = dict(zip(dcols, fit.coefficients.toArray().tolist(), strict=True))
    parts = F.array(*(F.struct(F.lit(c[2:]).alias("feature"), F.lit(i).alias("pos"), (F.lit(w[c]) * F.col(c)).alias("phi")) for i, c in enumerate(dcols)))
    return d.select(key, F.explode(parts).alias("x")).select(key, "x.*")


def top_contributions(c: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("phi")), "pos")
    return c.where("phi <> 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def score_block(df: DataFrame, label: str, models: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """(by, model, n, accuracy, log_loss, brier) of several probabilities on the rows where each is known, in one pass."""
    parts = F.array(*(F.struct(F.lit(m).alias("model"), p.cast("double").alias("p")) for m, p in models.items()))
    x = df.select(*by, F.col(label).alias("_y"), F.explode(parts).alias("_m")).select(*by, "_y", "_m.model", "_m.p").where("p is not null and _y is not null")
    y, p = F.col("_y"), F.col("p")
    return x.groupBy(*by, "model").agg(F.count("*").alias("n"), accuracy(y, p).alias("accuracy"), log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier"))


def bootstrap_difference(df: DataFrame, key: str, a: Column, b: Column, rounds: int = 500, seed: int = 7) -> tuple[float, float, float]:
    """(mean, low, high): paired bootstrap of mean(a - b) with a 95 % percentile interval.

    Each row is drawn a Poisson(1) number of times per round, from a hash of its key, so rounds are aggregated in
    one pass without a cross join.
    """
    diff = (a - b).cast("double")

    def draws(batches):
        import pandas as pd

        s, n = np.zeros(rounds), np.zeros(rounds)
        for t in batches:
            for k, d in zip(t["k"], t["d"], strict=True):
                w = np.random.default_rng([seed, int(k) & 0xFFFFFFFF, int(k) >> 32 & 0xFFFFFFFF]).poisson(1.0, rounds)
                s += w * d
                n += w
        yield pd.DataFrame({"r": np.arange(rounds), "s": s, "n": n})

    x = df.select(F.xxhash64(key).alias("k"), diff.alias("d")).where("d is not null")
    per = x.mapInPandas(draws, "r int, s double, n double").groupBy("r").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    mean = x.agg(F.avg("d")).first()[0]
    low, high = per.agg(F.percentile("m", F.lit(0.025)), F.percentile("m", F.lit(0.975))).first()
    return mean, low, high


class Registry:
    """Model versions as an append-only parquet log; the latest activation counts, so one version is active."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, version: str, event: str, metrics: dict) -> None:
        row = [(version, event, json.dumps(metrics, sort_keys=True, allow_nan=False))]
        self.spark.createDataFrame(row, "version string, event string, metrics string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def register(self, version: str, metrics: dict) -> None:
        if os.path.exists(self.path) and not self.log().where((F.col("version") == version) & (F.col("event") == "registered")).isEmpty():
            raise ValueError(f"version {version} exists")
        self._append(version, "registered", metrics)

    def activate(self, version: str) -> None:
        if self.log().where((F.col("version") == version) & (F.col("event") == "registered")).isEmpty():
            raise ValueError(f"no version {version}")
        self._append(version, "activated", {})

    def active(self) -> str | None:
        r = self.log().where("event = 'activated'").agg(F.max_by("version", "at").alias("v")).first()
        return r.v

    def list(self) -> DataFrame:
        return self.log().where("event = 'registered'").orderBy(F.desc("at"), F.desc("version"))


def _hash_folder(path: str) -> str:
    h = hashlib.sha256()
    for root, dirs, files in os.walk(path):
        dirs.sort()
        for f in sorted(files):
            if not f.endswith(".crc"):
                h.update(f.encode())
                with open(os.path.join(root, f), "rb") as x:
                    h.update(x.read())
    return h.hexdigest()


def write_bundle(path: str, model: Pairwise, extra: dict) -> None:
    """Model and manifest; half-written artefacts are removed on failure."""
    try:
        model.model.write().overwrite().save(f"{path}/model")
        manifest = {"names": model.names, "kind": type(model.model).__name__, "sha256": _hash_folder(f"{path}/model"), **extra}
        with open(f"{path}/manifest.json", "w") as f:
            json.dump(manifest, f, sort_keys=True, allow_nan=False)
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise


def load_bundle(path: str, names: list[str]) -> Pairwise:
    """The model, if its bytes and feature names are those of the manifest."""
    from pyspark.ml.classification import GBTClassificationModel

    with open(f"{path}/manifest.json") as f:
        m = json.load(f)
    if m["names"] != names:
        raise ValueError(f"features differ: {m['names']} and {names}")
    if m["sha256"] != _hash_folder(f"{path}/model"):
        raise ValueError("the model's files have changed")
    return Pairwise(GBTClassificationModel.load(f"{path}/model"), names)
