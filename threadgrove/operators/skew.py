"""Joins whose left side may have keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The HOT_KEYS largest keys are split by salts; their list has a fixed size bound, so it may be broadcast. A key
# beyond them holds less than 1/HOT_KEYS of all rows and is left to the engine's own split of skewed joins.
HOT_KEYS = 100_000
HOT_ROWS = 100_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
           hot_rows: int | None = None, counted: DataFrame | None = None,
           counts: DataFrame | None = None) -> DataFrame:
    """Join many rows to a right side that is unique on `keys`, splitting hot left keys.

    Left rows of a hot key (more than `hot_rows`, by default HOT_ROWS, rows) are spread over sub-keys of
    about `hot_rows` rows by a hash of the row and of its input partition, and only the one right row of that
    key is repeated once per sub-key. The partition spreads rows that are equal in all columns, and unlike a row
    number it is the same when a lost task runs again. All other keys join as usual, in the same join. `counted` is a cheaper table with the same keys, to find the hot ones in;
    `counts` (keys, `_n`) saves counting.
    """
    if counts is None:
        counts = (left if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = HOT_ROWS if hot_rows is None else hot_rows
    hot = counts.filter(F.col("_n") > size).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(
        *keys, F.ceil(F.col("_n") / size).cast("bigint").alias("_salts"))
    rest = [c for c, t in left.dtypes
            if c not in keys and "map<" not in t]
    salt_count = F.coalesce("_salts", F.lit(1).cast("bigint"))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*rest, F.spark_partition_id()), salt_count)).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), salt_count - 1))
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", copies).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
