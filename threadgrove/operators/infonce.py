"""InfoNCE over stored vectors, as an offline figure per pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadgrove.functions.vectors import dot, logsumexp, unit


def explicit(pairs: DataFrame, negatives: DataFrame, key: str = "sample_index", temperature: float = 0.05,
             bidirectional: bool = False) -> DataFrame:
    """Loss per pair against its own negatives.

    `pairs`: key, anchor, positive vectors; `negatives`: key, negative vector. A pair without
    negatives has loss 0. The list of logits of one pair is as long as its number of negatives.
    """
    p = pairs.select(key, unit("anchor").alias("_a"), unit("positive").alias("_p"))
    n = negatives.select(key, unit("negative").alias("_n"))
    joined = p.join(n, key, "left")
    sides = [("_a", "_p")] + ([("_p", "_a")] if bidirectional else [])
    sims = joined.select(key, (dot("_a", "_p") / temperature).alias("_pos"), F.col("_n").isNotNull().alias("_some"),
                         *[(dot(q, "_n") / temperature).alias(f"_neg{i}") for i, (q, _) in enumerate(sides)])
    grouped = sims.groupBy(key).agg(F.max("_pos").alias("_pos"), F.bool_or("_some").alias("_some"),
                                    *[F.collect_list(f"_neg{i}").alias(f"_neg{i}") for i in range(len(sides))])
    loss = sum((logsumexp(F.array_append(f"_neg{i}", F.col("_pos"))) - F.col("_pos") for i in range(len(sides))),
               F.lit(0.0)) / len(sides)
    return grouped.select(key, F.when(F.col("_some"), loss).otherwise(F.lit(0.0)).alias("loss"))


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """One matrix per row of a column of vector lists."""
    sizes = column.value_lengths().to_pylist()
    flat = column.flatten()
    dense = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    ends = np.cumsum([s or 0 for s in sizes])
    return [dense[e - (s or 0):e] for s, e in zip(sizes, ends)]


def _rows_lse(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(axis=1))


def in_batch(rows: DataFrame, temperature: float = 0.05, bidirectional: bool = False, normalize: bool = True,
             extra: DataFrame | None = None) -> DataFrame:
    """Loss per row where the other positives of the batch are the negatives.

    `rows`: batch_id, position, anchor, positive. `extra` (batch_id, negative) adds further negatives
    for every anchor of the batch. One batch is one group, so its size is the batch size chosen by
    the user; many batches are computed per Arrow block.
    """

    def losses(anchors: pa.Array, positives: pa.Array, extras: pa.Array) -> pa.Array:
        out = []
        for a, p, e in zip(_matrices(anchors), _matrices(positives), _matrices(extras)):
            if normalize:
                a, p, e = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (a, p, e)]
            sims = a @ p.T / temperature
            own = np.diag(sims)
            logits = np.hstack([sims, a @ e.T / temperature]) if len(e) else sims
            loss = _rows_lse(logits) - own
            if bidirectional:
                loss = (loss + _rows_lse(sims.T) - own) / 2
            out.append(loss)
        return pa.array(out, pa.list_(pa.float64()))

    compute = F.arrow_udf(losses, T.ArrayType(T.DoubleType()))
    items = F.sort_array(F.collect_list(F.struct("position", "anchor", "positive")))
    batches = rows.groupBy("batch_id").agg(items.alias("_i"))
    empty = F.array().cast("array<array<double>>")
    if extra is None:
        batches = batches.withColumn("_e", empty)
    else:
        more = extra.groupBy("batch_id").agg(F.collect_list(F.col("negative").cast("array<double>")).alias("_e"))
        batches = batches.join(more, "batch_id", "left").withColumn("_e", F.coalesce("_e", empty))
    done = batches.select("batch_id", F.col("_i.position").alias("_pos"),
                          compute(F.col("_i.anchor"), F.col("_i.positive"), F.col("_e")).alias("_loss"))
    return done.select("batch_id", F.explode(F.arrays_zip("_pos", "_loss")).alias("_x")).select(
        "batch_id", F.col("_x._pos").alias("position"), F.col("_x._loss").alias("loss"))
