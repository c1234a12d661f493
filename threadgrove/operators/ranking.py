"""Ranks, dense indexes and prefix sums that never put one whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.functions.hashing import HASH_BITS, portable_hash
from threadgrove.session import stored

# Row limits up to this size are pruned per map task before the shuffle of a ranking window.
PRUNED_LIMIT = 1000


def _grouped(df: DataFrame, group: list[str]) -> DataFrame:
    """Add `_g`, the group as one struct: never NULL itself, so rows of NULL groups join and count too."""
    return df.withColumn("_g", F.struct(*group) if group else F.lit(0))


def hash_rank(df: DataFrame, group: list[str], key: list[str], seed, name: str = "rank",
              size: str | None = None, bits: int = 16) -> DataFrame:
    """Exact 1-based rank of every row in its group, in seeded-hash order; ties fall to `key`.

    The 32-bit hash space is cut into 2^bits ranges. Rows are numbered inside one (group, range) cell,
    and the number of rows in the earlier ranges of the group, known from a small count table, is
    added. A group with a third of the rows is thus numbered by 2^bits tasks, not by one. The rows are
    shuffled once: the join uses the partitioning and order of the window.
    `size` adds the number of rows in the group.
    """
    cells = _grouped(df, group).withColumn("_h", portable_hash(seed, *key)).withColumn(
        "_cell", F.shiftright("_h", HASH_BITS - bits))
    counts = cells.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy("_g")
    before = counts.select(
        "_g", "_cell",
        (F.sum("_n").over(across.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_before"),
        F.sum("_n").over(across).alias("_size"))
    inside = Window.partitionBy("_g", "_cell").orderBy("_h", *key)
    ranked = cells.withColumn("_inside", F.row_number().over(inside)).join(before, ["_g", "_cell"])
    out = ranked.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name),
                        *([F.col("_size").cast("bigint").alias(size)] if size else []))
    return out


def dense_index(df: DataFrame, key: list[str], seed, name: str = "idx") -> DataFrame:
    """Dense 0-based index over the whole table in seeded-hash order."""
    return hash_rank(df, [], key, seed, name).withColumn(name, F.col(name) - 1)


def take_by_hash(df: DataFrame, group: list[str], key: list[str], n: int, seed) -> DataFrame:
    """Seeded sample of at most n rows per group."""
    if n > PRUNED_LIMIT:
        return hash_rank(df, group, key, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    h = portable_hash(seed, *key)
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(h, *key)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1,
                   name: str | None = None) -> DataFrame:
    """First n rows per group; map tasks send at most n rows per group into the shuffle.

    Spark prunes like this up to `spark.sql.optimizer.windowGroupLimitThreshold`, which `session.builder` lifts to
    any n; a session with Spark's default does so up to 1000.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", name) if name else out.drop("_rank")


def running_totals(df: DataFrame, value: str, measures: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Prefix sums of measures over the ordered distinct values of each group.

    Gives one row per (group, value) with each measure `m`, `m_before` (sum over smaller values) and
    `m_all` (group sum). Values are first collapsed, then summed cell by cell. A cell is one range partition
    of (group, value), so its edges come from the data and crowded values are spread like all others. The
    collapsed table is written once: the ranges are drawn a single time, however often a task is repeated.
    """
    group = group or []
    rows = _grouped(df.filter(F.col(value).isNotNull()), group)
    cells = stored(rows.groupBy("_g", value).agg(*[m.alias(k) for k, m in measures.items()])
                   .repartitionByRange("_g", value).withColumn("_cell", F.spark_partition_id()))
    sums = cells.groupBy("_g", "_cell").agg(*[F.sum(k).alias(f"_s_{k}") for k in measures])
    across = Window.partitionBy("_g")
    upto = across.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.select(
        "_g", "_cell",
        *[(F.sum(f"_s_{k}").over(upto) - F.col(f"_s_{k}")).alias(f"_o_{k}") for k in measures],
        *[F.sum(f"_s_{k}").over(across).alias(f"{k}_all") for k in measures])
    inside = Window.partitionBy("_g", "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = cells.select("*", *[(F.sum(k).over(inside) - F.col(k)).alias(f"_l_{k}") for k in measures])
    out = local.join(offsets, ["_g", "_cell"])
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in group], value, *measures,
                      *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(f"{k}_before") for k in measures],
                      *[f"{k}_all" for k in measures])


def exact_quantiles(df: DataFrame, value: str, fractions: dict[str, float],
                    group: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group from prefix counts; no group is collected."""
    group = group or []
    ranked = running_totals(df, value, {"_n": F.count(F.lit(1))}, group)
    first, last, n = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1, F.col("_n_all")
    aggs = []
    for name, q in fractions.items():
        at = F.lit(q) * (n - 1)
        low, high = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((first <= low) & (low <= last), F.col(value))).alias(f"_{name}_lo"),
                 F.max(F.when((first <= high) & (high <= last), F.col(value))).alias(f"_{name}_hi")]
    picked = ranked.groupBy(*group).agg(F.max("_n_all").alias("_n_all"), *aggs)
    out = [(F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo"))
            * (F.lit(q) * (F.col("_n_all") - 1) - F.floor(F.lit(q) * (F.col("_n_all") - 1)))).alias(k)
           for k, q in fractions.items()]
    return picked.select(*group, *out)
