"""Cogrouped Arrow functions over hash buckets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _whole(t: pa.Table, schema: pa.Schema) -> pa.Table:
    return t if t.num_columns else schema.empty_table()


def by_bucket(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, buckets: int, run: Callable, schema: str) -> DataFrame:
    """``run(left, right)`` for each bucket, where either table may be empty but has its columns.

    Keys of both sides must be of one type. The columns of the right side are renamed to themselves, as
    two sides that come from one table would otherwise share their attributes.
    """
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets))
    a = left.select(*(F.col(c).alias(c) for c in left.columns), bucket(left_key).alias("_bucket"))
    b = right.select(*(F.col(c).alias(c) for c in right.columns), bucket(right_key).alias("_bucket"))
    sa, sb = to_arrow_schema(a.schema), to_arrow_schema(b.schema)
    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInArrow(lambda x, y: run(_whole(x, sa), _whole(y, sb)), schema)
