"""Builds of derived tables with a pointer to the current one, and their lineage."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IncompleteBuild(ValueError):
    """A target lacks rows that it must have."""


class Builds:
    """A derived table as immutable build folders; readers follow a pointer that is replaced in one step.

    A build is validated before the pointer moves, so a failed one is never seen. The pointer is a small file
    on a file system that renames atomically.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def publish(self, df: DataFrame, key: list[str], expected: int | None = None, targets: DataFrame | None = None, **report) -> str:
        build = uuid.uuid4().hex
        folder = f"{self.path}/build={build}"
        df.write.parquet(folder)
        made = self.spark.read.parquet(folder)
        if expected is not None and targets is not None:
            n = made.groupBy(*key).count()
            bad = targets.select(*key).distinct().join(n, key, "left").where(F.coalesce("count", F.lit(0)) != expected).limit(5).collect()
            if bad:
                raise IncompleteBuild(f"not {expected} rows: {[tuple(r[k] for k in key) for r in bad]}")
        row = [(build, made.count(), json.dumps(report, sort_keys=True, allow_nan=False))]
        self.spark.createDataFrame(row, "build string, rows_loaded long, report string").withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/load_runs")
        with open(f"{self.path}/current.tmp", "w") as f:
            f.write(build)
        os.replace(f"{self.path}/current.tmp", f"{self.path}/current")
        return build

    def current(self) -> DataFrame:
        with open(f"{self.path}/current") as f:
            return self.spark.read.parquet(f"{self.path}/build={f.read().strip()}")

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/load_runs")
