"""Putting one-row results side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of `left` with the columns of the one row of `right`, as a scalar subquery, not a join."""
    one = right.select(F.struct(*right.columns).alias("_row")).scalar()
    return left.withColumn("_row", one).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in right.columns])
