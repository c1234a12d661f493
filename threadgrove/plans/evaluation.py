"""All metrics of one encoder in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadgrove.functions.rows import beside
from threadgrove.operators import clustering, retrieval
from threadgrove.session import stored


def evaluate_encoder(encoder: str, train: DataFrame, test: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10),
                     id_col: str = "id", label: str = "label", vec: str = "embedding", kmeans: bool = True,
                     centroids: bool = True, block: int = 2048) -> DataFrame:
    """Precision and MRR of train rows querying test rows; class separation and clusters of the test rows."""
    train, test = stored(train.select(id_col, label, vec)), stored(test.select(id_col, label, vec))
    ranked = retrieval.evaluate(train, test, ks, id_col, label, vec, block).drop("sample_count")
    apart = clustering.class_separation(test, label, vec, centroids).select(
        F.col("intra_class_similarity").alias("intra_sim"), F.col("inter_class_similarity").alias("inter_sim"), "margin")
    out = beside(ranked, apart).withColumn("encoder", F.lit(encoder))
    if kmeans:
        rows, inertia = clustering.kmeans_labels(test, label=label, vec=vec)
        table = stored(clustering.contingency(rows, label))
        for part in (clustering.nmi(table), clustering.ari(table),
                     clustering.cluster_accuracy(table).withColumnRenamed("accuracy", "acc")):
            out = beside(out, part)
        out = out.withColumn("inertia", F.lit(float(inertia)))
    return out


def compare_encoders(tables: dict[str, tuple[DataFrame, DataFrame]], **options) -> DataFrame:
    """One row per encoder from {encoder: (train, test)}."""
    out = None
    for name, (train, test) in tables.items():
        row = evaluate_encoder(name, train, test, **options)
        out = row if out is None else out.unionByName(row)
    return out
