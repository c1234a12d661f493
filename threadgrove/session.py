"""Session defaults and lineage cutting through the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession


def builder(master: str | None = None, cores: int | None = None) -> SparkSession.Builder:
    """Session builder with the settings the library relies on.

    AQE coalesces small shuffle partitions and splits skewed join partitions; the forced form
    also splits when the extra exchange is the price.
    """
    b = (
        SparkSession.builder.appName("threadgrove")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # row limits per group are pruned before the shuffle for any limit
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "2147483647")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if cores:
        b = b.config("spark.sql.shuffle.partitions", str(cores))
    return b


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's `spark.checkpoint.dir`.

    Where it is unset, a local session uses its warehouse folder. A cluster session must name a folder every
    executor can reach, otherwise a lost executor would lose the table.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/threadgrove"


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of jobs that start inside have about `most` bytes, so that long rows take little memory outside the heap and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, observation: Observation | None = None, group_rows: int | None = None, **metrics) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where a plan would otherwise be evaluated several times or grow without end. The written
    table survives executor loss, is columnar and carries sizes for the join planner. Metrics, if
    any, are collected during the same write. All tables of an application share one folder, which can be removed
    when the application has ended. `group_rows` limits the rows of a row group, which a writer holds and a reader decodes
    as a whole: by itself parquet first looks at their size after 100 rows, too late for rows of some MB.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadgrove-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if observation is not None:
        df = df.observe(observation, *[c.alias(k) for k, c in metrics.items()])
    written = df.write.option("compression", "zstd")
    if group_rows is not None:
        written = written.option("parquet.block.row.count.limit", group_rows)
    written.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
