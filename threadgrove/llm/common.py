"""What the operators of this package share: held-out rows, bounded samples, texts of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.functions.hashing import HASH_BITS, portable_hash

LEAST = 32


def crc_rest(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo `divisor`. A null doc_id counts as empty text, so its rest is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def bounded_sample(df: DataFrame, key: str, limit: int, seed: str) -> DataFrame:
    """The rows whose seeded hash of `key` is below limit / (number of rows): about `limit` rows at most.

    One count, one filter; no sort, no single task. All rows if there are no more than `limit`.
    """
    share = min(1.0, limit / max(1, df.count()))
    return df.filter(portable_hash(seed, key) < int(share * (1 << HASH_BITS)))


def class_shares(sizes: dict, limit: int) -> dict:
    """The share of each class to draw: of every class up to limit / classes rows (`LEAST` at least), the rest of
    `limit` in proportion to what is left of the classes."""
    sure = {c: min(n, max(LEAST, limit // len(sizes))) for c, n in sizes.items()}
    left, rest = sum(sizes.values()) - sum(sure.values()), max(0, limit - sum(sure.values()))
    share = min(1.0, rest / left) if left else 0.0
    return {c: (sure[c] + share * (n - sure[c])) / n for c, n in sizes.items()}


def stratified_sample(df: DataFrame, key: str, by: str, limit: int, seed: str) -> tuple[DataFrame, dict]:
    """About `limit` rows of `df`, drawn as in `bounded_sample` with a share for each class, and the rows of each class
    in `df`. `by` has no nulls. A column `weight` tells how many rows of its class a row stands for."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if not sizes:
        return df.withColumn("weight", F.lit(1.0)), sizes
    shares = class_shares(sizes, limit)
    share = F.create_map(*[x for c in sizes for x in (F.lit(c), F.lit(float(shares[c])))])[F.col(by)]
    drawn = df.filter(portable_hash(seed, key) < F.floor(share * (1 << HASH_BITS)))
    return drawn.withColumn("weight", 1.0 / share), sizes


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, trained: Column, limit: int,
                    seed: str) -> DataFrame:
    """doc_id, text, label, weight of about `limit` labelled documents among those that satisfy `trained`, up to
    limit / labels from each label; `weight` is how many labelled documents a row stands for.

    Null labels and null ids are left out; of several labels of one document the largest counts. The labels
    are sampled first, so only the bounded sample meets the texts, as a broadcast.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & trained)
             .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")))
    picked, _ = stratified_sample(known.filter(F.col("label").isNotNull()), "doc_id", "label", limit, seed)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null is empty. No copy is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return at.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def groups_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` units each; a larger row is a range of its own."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)
