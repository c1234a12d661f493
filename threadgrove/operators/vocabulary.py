"""Vocabulary over all texts, and texts as padded token-id arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from threadgrove.functions.text import words
from threadgrove.operators.ranking import hash_rank
from threadgrove.session import batch_bytes, stored

PAD, UNK = 0, 1  # fixed values: ids of <pad> and <unk>; words start at 2
PART_TOKENS = 1 << 20
BATCH_BYTES = 8 << 20  # of texts on their way to a part


def vocabulary(df: DataFrame, tokenize: Callable[[Column], Column] = words, min_freq: int = 1,
               text: str = "content", seed: int = 0) -> DataFrame:
    """token, count, id: frequent words first, equal counts in seeded-hash order.

    Words are counted with map-side combining. Ids are dense without a global sort: the number of
    more frequent words comes from the table of distinct counts (at most sqrt(2 * words) rows), the
    place among equally frequent words from `hash_rank`. The counts are written once, the texts are read once.
    """
    counts = stored(df.select(F.explode(tokenize(F.col(text))).alias("token")).groupBy("token")
                    .agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_freq))
    per_count = counts.groupBy("count").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(F.lit(0)).orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1))
    above = per_count.select("count", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_above"))
    ranked = hash_rank(counts, ["count"], ["token"], seed, "_r")
    return ranked.join(above, "count").select(
        "token", "count", (F.col("_above") + F.col("_r") + 1).cast("bigint").alias("id"))


def special_tokens(vocab: DataFrame) -> DataFrame:
    """The vocabulary with the two reserved entries."""
    reserved = vocab.sparkSession.createDataFrame([("<pad>", 0, PAD), ("<unk>", 0, UNK)],
                                                  "token string, count bigint, id bigint")
    return reserved.unionByName(vocab)


def dictionary_parts(rows: DataFrame, tokens: str, part_tokens: int = PART_TOKENS) -> DataFrame:
    """part, rows, words: consecutive rows with about `part_tokens` tokens together, in one row.

    `words` are the distinct tokens of the part, `rows` the other columns with `codes`, the places of a row's tokens
    among the words, and their number `n`. A row with more tokens is a part of its own. `tokens` must not be null.
    """
    kept = [f for f in rows.schema.fields if f.name != tokens]
    names = [f.name for f in kept]
    row = T.StructType([*kept, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("rows", T.ArrayType(row)),
                           T.StructField("words", T.ArrayType(T.StringType()))])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, total = [], 0
        for b in batches:
            first = 0
            for i, n in enumerate(pc.list_value_length(b.column(tokens)).to_pylist()):
                if total and total + n > part_tokens:
                    held.append(b.slice(first, i - first))
                    yield pa.Table.from_batches(held)
                    held, total, first = [], 0, i
                total += n
            held.append(b.slice(first))
        if held:
            yield pa.Table.from_batches(held)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches):
            part = part.combine_chunks()
            if not part.num_rows:
                continue
            lists = part.column(tokens).chunk(0)
            coded = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
            sizes = pc.list_value_length(lists).cast(pa.int32())
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
            codes = pa.ListArray.from_arrays(ends, coded.indices)
            fields = pa.StructArray.from_arrays([*[part.column(c).chunk(0) for c in names], codes, sizes], [*names, "codes", "n"])
            words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), fields), words],
                                             ["part", "rows", "words"])
            number += 1

    return rows.mapInArrow(encode, schema)


def part_ids(met: DataFrame) -> DataFrame:
    """part, _ids: the `_id`s of each part by `_place`. A task sorts, on disk if need be, and holds the ids of one part, however many it has."""
    rows = met.select("part", "_place", "_id").repartition("part").sortWithinPartitions("part", "_place").select("part", "_id")

    def one(part: int, held: list[pa.Array]) -> pa.RecordBatch:
        ids = pa.concat_arrays(held)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["part", "_ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in batches:
            part, ids = np.asarray(b.column("part")), b.column("_id")
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if held and part[x] != here:
                    yield one(here, held)
                    held = []
                here = int(part[x])
                held.append(ids.slice(x, y - x))
        if held:
            yield one(here, held)

    return rows.mapInArrow(join, "part bigint, _ids array<bigint>")


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, tokenize: Callable[[Column], Column] = words,
                  text: str = "content", max_len: int | None = 256, pad: str = "max_length",
                  batch: str | None = None) -> DataFrame:
    """key, input_ids, attention_mask of every row. Unknown words become 1, short rows are filled with 0.

    `pad`: 'max_length', 'longest' or 'none'. The longest row is that of the same batch, if `batch` names the
    column of batches (no batch is a batch too), else that of the table. Rows with one key stay apart, a null or blank text
    has no tokens, and `vocab` holds a token once.

    No token is a row: texts are coded by the dictionary of their part, written once, and only the distinct words of a
    part meet the vocabulary. A word is in a part once, so no word is a hot key, however frequent. Tasks write, read and
    decode one part at a time, so what they hold does not grow with the number of their parts.
    """
    tokens = tokenize(F.col(text))
    if max_len is not None:
        tokens = F.slice(tokens, 1, max_len)
    rows = df.select(F.col(key).alias("k"), F.struct(*[F.col(batch)] if batch else [F.lit(0)]).alias("b"),
                     F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    with batch_bytes(df.sparkSession, BATCH_BYTES):
        parts = stored(dictionary_parts(rows, "tokens"), group_rows=1)
    known = vocab.select("token", F.col("id").cast("bigint").alias("_id"))
    met = parts.select("part", F.posexplode("words").alias("_place", "token")).join(known, "token", "left")
    ids = part_ids(met.select("part", "_place", F.coalesce("_id", F.lit(UNK).cast("bigint")).alias("_id")))
    coded = parts.select("part", "rows").join(ids, "part", "left").select(F.explode(F.transform("rows", lambda r: F.struct(
        r["k"].alias("k"), r["b"].alias("b"), F.transform(r["codes"], lambda c: F.get("_ids", c)).alias("ids")))).alias("r"))
    rows = coded.select(F.col("r.k").alias(key), F.col("r.b").alias("_b"), F.col("r.ids").alias("_ids"))
    if pad == "none":
        width = F.size("_ids")
    elif pad == "longest":
        widths = parts.select(F.explode("rows").alias("r")).groupBy(F.col("r.b").alias("_b")).agg(F.max("r.n").alias("_width"))
        rows, width = rows.join(widths, "_b"), F.col("_width")
    else:
        width = F.lit(max_len)
    fill = F.greatest(width - F.size("_ids"), F.lit(0))
    return rows.select(
        key, F.concat("_ids", F.array_repeat(F.lit(PAD).cast("bigint"), fill)).alias("input_ids"),
        F.concat(F.transform("_ids", lambda _: F.lit(1).cast("bigint")),
                 F.array_repeat(F.lit(0).cast("bigint"), fill)).alias("attention_mask"))
