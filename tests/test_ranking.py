"""Ranks, prefix sums, quantiles and split joins against plain Python, with hot groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadgrove.functions.hashing import portable_hash
from threadgrove.operators.ranking import dense_index, exact_quantiles, hash_rank, running_totals, take_by_hash
from threadgrove.operators.skew import lookup


@pytest.fixture(scope="module")
def hot(spark):
    """2000 rows in one group, 1000 in small groups, some without a group."""
    rows = [(i, "hot" if i < 2000 else (None if i % 10 == 0 else f"g{i % 300}"), float((i * 37) % 101) / 50 - 1) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, grp string, v double").cache()


def test_hash_rank_is_a_dense_rank_in_hash_order(hot):
    got = hash_rank(hot.withColumn("h", portable_hash(7, "id")), ["grp"], ["id"], 7, "rank", "size").toPandas()
    assert len(got) == 3000
    for _, g in got.groupby("grp", dropna=False):
        g = g.sort_values(["h", "id"])
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert (g["size"] == len(g)).all()


def test_dense_index_covers_the_range(hot):
    got = dense_index(hot, ["id"], 1).toPandas()
    assert sorted(got["idx"]) == list(range(3000))


@pytest.mark.parametrize("n", [3, 1500])
def test_take_by_hash_caps_every_group(hot, n):
    got = take_by_hash(hot, ["grp"], ["id"], n, 5).groupBy("grp").count().toPandas()
    full = hot.groupBy("grp").count().toPandas()
    merged = full.merge(got, on="grp", suffixes=("_full", "_got"))
    assert len(merged) == len(full)
    assert (merged["count_got"] == merged["count_full"].clip(upper=n)).all()


def test_quantiles_equal_numpy(hot):
    got = exact_quantiles(hot, "v", {"a": 0.5, "b": 0.9, "c": 0.03}, group=["grp"]).toPandas()
    pdf = hot.toPandas()
    assert len(got) == pdf["grp"].nunique(dropna=False)
    for row in got.itertuples():
        v = pdf[pdf.grp.isna() if row.grp is None else pdf.grp == row.grp].v
        assert np.allclose([row.a, row.b, row.c], np.percentile(v, [50, 90, 3]))


def test_running_totals(hot):
    got = running_totals(hot, "v", {"n": F.count(F.lit(1))}).toPandas().sort_values("v")
    v = hot.toPandas().v
    assert got.n.sum() == 3000 and (got.n_all == 3000).all()
    assert got.n_before.tolist() == [int((v < x).sum()) for x in got.v]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_a_plain_join_when_keys_are_split(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("g1", 2), ("g2", 3), ("unused", 4)], "grp string, w int")
    plain = hot.join(right, ["grp"], how)
    split = lookup(hot, right, ["grp"], how, hot_rows=100)
    order = sorted(plain.columns)
    a, b = [d.select(*order).toPandas().sort_values("id").reset_index(drop=True) for d in (plain, split)]
    pd.testing.assert_frame_equal(a, b)


def test_lookup_spreads_a_hot_key(spark, hot):
    right = spark.createDataFrame([("hot", 1)], "grp string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = lookup(hot, right, ["grp"], hot_rows=100).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 2


def test_crowded_values_are_spread_over_cells(spark):
    """100,000 values below 1e-5: their totals are exact and no task gets most of them."""
    df = spark.range(100_000).select((F.col("id") * 1e-10).alias("v"))
    out = running_totals(df, "v", {"n": F.count(F.lit(1))})
    assert out.filter(F.abs(F.col("n_before") - F.col("v") * 1e10) > 0.5).count() == 0
    cells = df.repartitionByRange(8, "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert cells < 50_000


def test_equal_rows_of_a_hot_key_use_many_salts(spark):
    left = spark.range(0, 4000, 1, 16).select(F.lit("a").alias("k"))
    right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    joined = lookup(left, right, ["k"], hot_rows=40)
    assert joined.count() == 4000 and joined.agg(F.sum("v")).first()[0] == 4000


def test_every_one_of_many_hot_keys_is_split(spark):
    left = spark.range(20_000).select((F.col("id") % 2000).alias("k"), "id")
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    out = lookup(left, right, ["k"], hot_rows=5)
    assert out.count() == 20_000 and out.filter(F.col("v") != F.col("k") * 3).count() == 0
