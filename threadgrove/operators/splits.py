"""Train, validation and test splits per label; every split is a rank in seeded-hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadgrove.operators.ranking import hash_rank, running_totals


def exclude_labels(df: DataFrame, labels: list, label: str = "label") -> DataFrame:
    """Rows whose label is not in a short list; rows without a label stay."""
    return df.filter(F.col(label).isNull() | ~F.col(label).isin(labels)) if labels else df


def _ranked(df: DataFrame, key: str, label: str, seed) -> DataFrame:
    return hash_rank(df, [label], [key], seed, "_r", "_n")


def _labelled(df: DataFrame, part, columns: list[str]) -> DataFrame:
    return df.select(*columns, part.alias("part")).filter(F.col("part").isNotNull())


def split_fixed(df: DataFrame, n_train: int, n_val: int, short_ratio: float = 0.2, key: str = "id",
                label: str = "label", seed: int = 42) -> DataFrame:
    """Per label the first n_train rows for training and the last n_val for validation.

    A label with too few rows for both is split by `short_ratio`. Adds `part`; unused rows drop out.
    """
    r, n = F.col("_r"), F.col("_n")
    enough = n >= n_train + n_val
    cut = n - F.ceil(n * F.lit(short_ratio))
    part = (F.when(enough & (r <= n_train), "train").when(enough & (r > n - n_val), "val")
            .when(~enough & (r <= cut), "train").when(~enough, "val"))
    return _labelled(_ranked(df, key, label, seed), part, df.columns)


def split_two_files(train: DataFrame, test: DataFrame, n_train: int, n_val: int, n_test: int, key: str = "id",
                    label: str = "label", seed: int = 42) -> DataFrame:
    """Training rows from one table; validation, then test rows from the other, without overlap.

    A label with too few rows in the second table is divided in the ratio n_val : n_test.
    """
    first = _labelled(_ranked(train, key, label, seed), F.when(F.col("_r") <= n_train, "train"), train.columns)
    r, n = F.col("_r"), F.col("_n")
    enough = n >= n_val + n_test
    cut = n - F.ceil(n * F.lit(1 - n_val / (n_val + n_test)))
    part = (F.when(enough & (r <= n_val), "val").when(enough & (r <= n_val + n_test), "test")
            .when(~enough & (r <= cut), "val").when(~enough, "test"))
    return first.unionByName(_labelled(_ranked(test, key, label, seed), part, test.columns))


def split_ratio(df: DataFrame, val_ratio: float = 0.2, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """Every label is divided into training and validation rows in the same ratio."""
    part = F.when(F.col("_r") / F.col("_n") <= 1 - val_ratio, "train").otherwise("val")
    return _labelled(_ranked(df, key, label, seed), part, df.columns)


def take_fraction(df: DataFrame, fraction: float, key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """round(n * fraction) rows of every label (half to even)."""
    if fraction >= 1:
        return df
    ranked = _ranked(df, key, label, seed)
    return ranked.filter(F.col("_r") <= F.bround(F.col("_n") * F.lit(fraction), 0)).select(*df.columns)


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """label, label_id: sorted distinct labels numbered from 0, range by range."""
    smaller = running_totals(df.select(label).distinct(), label, {"_one": F.count(F.lit(1))})
    return smaller.select(label, F.col("_one_before").cast("bigint").alias("label_id"))
