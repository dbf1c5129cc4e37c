"""Scans of the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_instants(df: DataFrame) -> DataFrame:
    """``timestamp_ntz`` columns as ``timestamp`` (session zone), as watermarks and epochs need them."""
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of ``sf_dir``; with ``columns``, only these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return with_instants(df.select(*columns) if columns else df)
