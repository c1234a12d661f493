"""Explicit schemas of the tables that cross a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T

POSTS = T.StructType([
    T.StructField("note_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
])

COMMENTS = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("note_id", T.StringType()),
    T.StructField("parent_comment_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("seq", T.LongType()),
])

LABELLED = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("label", T.StringType()),
])

# One run inside the results file: a map from "<model>_frac<fraction>" to an array of these.
RUN = T.StructType([
    T.StructField("run_idx", T.LongType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("val_f1", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("test_precision", T.DoubleType()),
    T.StructField("test_recall", T.DoubleType()),
])
RUN_RESULTS = T.MapType(T.StringType(), T.ArrayType(RUN))

FILTER_ENTRY = T.StructType([
    T.StructField("strategy", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("consistency_score", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("passed", T.BooleanType()),
])
TRAINING_ROUNDS = T.MapType(T.StringType(), T.BooleanType())
FILTER_HISTORY = T.MapType(T.StringType(), FILTER_ENTRY)
