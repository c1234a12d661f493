"""Time-varying curriculum: sources mixed to target weights, each document at the training position its source
asks for.

A source's weight runs linearly over the training time t from 0 to 1: w(t) = target * (1 + slope * (2t - 1)). Its integral is
the source's cumulative token demand; inverting it at the words already taken from the source gives the time at
which a document is due. Sources are read in seeded hash order, again from the start if the target exceeds them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.functions.hashing import HASH_BITS, portable_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SLOPES = (0.0, 0.5, -0.5)
CELL_BITS = 12
BLANKS = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than blanks 0x20 and 0x09 to 0x0D; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank, target from (source, source_size), one row per source.

    The targets add up to `share` of all sizes, in proportion to the weights, except that no target exceeds `most`
    times its source's size; what is above is shared again among the rest. The end of that is one water level:
    target = min(cap, level * weight), found by prefix sums over the sources in order of cap / weight. The sources
    are the only rows here, so one window over them is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "*", ((F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
              / F.sum("weight").over(onwards)).alias("level"))
    # the first source in this order whose cap is not below the level fixes it; with none, every source is at its cap
    fixed = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")), "rank", "level"))).over(everything)
    leveled = levels.withColumn("fixed", fixed["level"])
    return leveled.select("source", "source_size", "rank",
                          F.least(F.col("cap"), F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap"))).alias("target"))


def due(taken_before: Column, target: Column, slope: Column) -> Column:
    """Time at which the integral of the weight schedule reaches a share taken_before / target of its total."""
    u = F.least(F.try_divide(taken_before, target), F.lit(1.0))
    base = F.lit(1.0) - slope
    bent = F.try_divide(F.sqrt(base * base + slope * u * 4) - base, slope * 2)
    return F.when(slope == 0, u).otherwise(bent)


def _placed(documents: DataFrame, carried: Column | None, weights: tuple, share: float, most: float, seed: str) -> DataFrame:
    """doc_id, size, `_row` (if carried), `_first` (words of the source before the document), source_size, rank, target, `_goal`."""
    h = portable_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")))
    group, cell = F.struct("source").alias("_g"), F.shiftright(h, HASH_BITS - CELL_BITS).cast("int").alias("_cell")
    size = words(F.col("text")).alias("size")
    rows = documents.select(group, cell, "doc_id", size, h.alias("_h"), F.xxhash64("text").alias("_x"), *([] if carried is None else [carried.alias("_row")]))
    cells = documents.select(group, cell, size).groupBy("_g", "_cell").agg(F.sum("size").alias("_words"))
    sources = cells.groupBy("_g").agg(F.sum("_words").alias("source_size")).select(F.col("_g.source").alias("source"), "source_size")
    goals = targets(sources, weights, share, most).select(F.struct("source").alias("_g"), "source_size", "rank", F.round("target", 6).alias("target"))
    upto = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_g", "_cell", F.coalesce(F.sum("_words").over(upto), F.lit(0)).alias("_start")).join(goals, "_g")
    inside = Window.partitionBy("_g", "_cell").orderBy("_h", "doc_id", "size", "_x").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(starts, ["_g", "_cell"]).withColumn("_first", F.col("_start") + F.col("_local")).withColumn(
        "_goal", F.floor("target").cast("bigint"))


def _taken(number: int) -> Column:
    """Words taken of a document in a pass over its source, counted from 0."""
    return F.least(F.greatest(F.col("_goal") - F.col("_first") - F.col("source_size") * number, F.lit(0)), F.col("size")).cast("bigint")


def _position(number: int, slopes: tuple) -> Column:
    """Training time of the middle of what the pass takes."""
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.col("rank") % len(slopes) + 1)
    middle = (F.col("_first") + F.col("source_size") * number).cast("double") + _taken(number) / F.lit(2.0)
    return F.when(_taken(number) > 0, F.round(due(middle, F.col("target"), slope), 9))


def mix(documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
        slopes: tuple = SLOPES, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, range-sorted by position (not taken: first).

    `taken` counts the words the mix takes of a document, over all passes; a source's taken words add up to the floor
    of its target. `position` is the training time of the document in the first pass, null if nothing is taken; the
    last document of the last pass may be taken in part. Weights are above 0, slopes within -1 and 1. Null texts have
    size 0, null sources are one source that sorts last, ids may be null or repeated (equal ids are ordered by size,
    then text hash; equal rows are interchangeable). A source without words has target 0. Prefix sums go by
    (source, hash range), so a source with a third of all rows is summed by thousands of tasks. An empty table
    gives an empty result; other columns are not read.
    """
    placed = _placed(documents, None, weights, share, most, seed)
    mixed = placed.select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target",
                         sum((_taken(p) for p in range(1, math.ceil(most))), _taken(0)).alias("taken"), _position(0, slopes).alias("position"))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_documents(documents: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
                       slopes: tuple = SLOPES, seed: str = "mix") -> DataFrame:
    """The mix as documents with the columns of `documents`, range-sorted by training position.

    A document comes once for every pass that takes it. Where a source's target is reached inside a document, the
    document is cut to the words still due (joined by blanks, `n_chars` corrected where there is such a column).
    """
    placed = _placed(documents, F.struct(*[documents[c] for c in documents.columns]), weights, share, most, seed)
    passes = F.array(*[F.struct(_taken(p).alias("words"), _position(p, slopes).alias("position"), F.lit(p).alias("pass")) for p in range(math.ceil(most))])
    rows = placed.select("_row", "size", F.explode(passes).alias("_p")).filter(F.col("_p.words") > 0)
    pieces = F.filter(F.split(F.col("_row.text"), BLANKS), lambda w: w != "")
    cut = F.col("_p.words") < F.col("size")
    text = F.when(cut, F.concat_ws(" ", F.slice(pieces, F.lit(1), F.col("_p.words").cast("int")))).otherwise(F.col("_row.text"))
    changed = {"text": text, "n_chars": F.when(cut, F.length(text)).otherwise(F.col("_row.n_chars"))}
    order = ["_p.position", "_p.pass", "_row.doc_id"]
    due_first = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = dict(documents.dtypes)
    return due_first.select(*[changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in documents.columns])
