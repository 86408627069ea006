"""Sums over tasks by a tree: values of the same part are combined FAN at a time, level by level."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
LEAVES = "part long, leaf long, value binary"


def tree_sum(leaves: DataFrame, combine: Callable[[list[bytes]], bytes]) -> DataFrame:
    """``leaves(part, leaf, value)`` -> one row for each part. ``leaf`` numbers the values of a part from 0, with gaps or not.

    ``leaves`` is read twice: write it first.
    """

    def combined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        value = combine([x.as_py() for x in table.column("value")])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()), "value": pa.array([value], pa.binary())})

    most = leaves.agg(F.max("leaf")).first()[0]
    while most:
        level = leaves.select("part", F.floor(F.col("leaf") / FAN).alias("leaf"), "value")
        leaves = level.groupBy("part", "leaf").applyInArrow(combined, LEAVES)
        most //= FAN
    return leaves.select("part", "value")
