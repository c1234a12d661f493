"""Vectors per (encoder, text), computed once and kept in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threadgrove.functions.text import EMPTY
from threadgrove.operators.skew import lookup
from threadgrove.session import stored

SCHEMA = T.StructType([
    T.StructField("encoder", T.StringType()), T.StructField("text_key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType()))])


def embed(df: DataFrame, make_model: Callable, in_col: str = "content", out_col: str = "embedding",
          batch_size: int = 64) -> DataFrame:
    """Add a vector per text. `make_model()` runs once per Python worker and returns texts -> matrix.

    Missing and empty texts are replaced by a placeholder, as the model needs some input.
    """
    text = F.coalesce(F.nullif(F.col(in_col), F.lit("")), F.lit(EMPTY))
    run = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, run(text))


def text_key(col: str = "content"):
    """Key of a text in the store."""
    return F.md5(F.coalesce(F.col(col), F.lit("")))


def missing_texts(texts: DataFrame, store: DataFrame, encoder: str, col: str = "content") -> DataFrame:
    """Distinct texts without a vector of this encoder: text_key, content."""
    wanted = texts.groupBy(text_key(col).alias("text_key")).agg(F.first(col).alias("content"))
    return wanted.join(store.filter(F.col("encoder") == encoder), "text_key", "left_anti")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The store, or an empty table when nothing was written yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def wanted_vectors(store: DataFrame, wanted: DataFrame, encoder: str) -> DataFrame:
    """text_key, embedding of the wanted keys, one vector each."""
    mine = store.filter(F.col("encoder") == encoder).join(wanted.select("text_key"), "text_key", "left_semi")
    return mine.groupBy("text_key").agg(F.min("embedding").alias("embedding"))


def add_embeddings(texts: DataFrame, path: str, encoder: str, make_model: Callable, col: str = "content",
                   batch_size: int = 64) -> DataFrame:
    """Vectors for all texts: compute and append the missing ones, then join the store by text key.

    The store is partitioned by encoder, so only one encoder's files are read. Equal texts are
    embedded once, and rows of a very frequent text are spread when they join its vector. Of several vectors of one
    text, as parallel appends may leave them, the smallest counts, so no row is doubled. The store meets the keys of
    the wanted texts, a written table of known size, before anything else: few keys are broadcast to its scan, and
    vectors of other texts go no further.
    """
    spark = texts.sparkSession
    wanted = stored(texts.select(text_key(col).alias("text_key")).distinct())
    todo = missing_texts(texts, read_store(spark, path), encoder, col)
    new = embed(todo, make_model, batch_size=batch_size).select(F.lit(encoder).alias("encoder"), "text_key", "embedding")
    new = stored(new)  # the store must not be read and appended to in one job
    new.write.mode("append").partitionBy("encoder").parquet(path)
    have = wanted_vectors(read_store(spark, path), wanted, encoder)
    return lookup(texts.withColumn("text_key", text_key(col)), have, ["text_key"]).drop("text_key")
