"""Consistency scores of pairs: statistics, noise injection, review samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.functions.consistency import consistency
from threadgrove.functions.rows import beside
from threadgrove.functions.text import preview
from threadgrove.operators.ranking import dense_index, exact_quantiles, hash_rank, take_by_hash
from threadgrove.operators.skew import lookup
from threadgrove.session import stored

SLACK = 1e-8  # fixed value: tolerance at the upper end of score ranges
REVIEW = [("very_low", 0.0, 0.2), ("low", 0.2, 0.4), ("medium", 0.4, 0.6), ("high", 0.6, 0.8),
          ("very_high", 0.8, 1.0)]  # fixed values: review intervals


def score_pairs(pairs: DataFrame, method: str = "confidence_weighted_dot_product",
                max_pairs: int | None = None) -> DataFrame:
    """Add `consistency_score` from `anchor_probs` and `positive_probs`.

    `max_pairs` keeps the pairs with the first sample indexes, as a filter on that dense index.
    """
    if max_pairs is not None:
        pairs = pairs.filter(F.col("sample_index") < max_pairs)
    return pairs.withColumn("consistency_score", consistency("anchor_probs", "positive_probs", method))


def attach_probabilities(pairs: DataFrame, classify: Callable[[DataFrame], DataFrame], anchor: str = "anchor_content",
                         positive: str = "positive_content", key: str | None = None) -> DataFrame:
    """Add `anchor_probs` and `positive_probs`, the classes of both texts of every pair.

    `classify` gets the distinct texts as (text_key, content) and adds `probs`; a text that occurs in very many
    pairs is classified once and its rows are split. A missing text has no probabilities. The probabilities are looked up by
    row number, so that the texts are shuffled once more for both. `key` names a column without nulls and unique in `pairs`, which
    must be a written table then; without it, `pairs` are written with row numbers.
    """
    names = [c for c in pairs.columns if c not in ("anchor_probs", "positive_probs")]
    row = key or "_row"
    keyed = pairs.select(*names, *[F.md5(c).alias(k) for c, k in ((anchor, "_a"), (positive, "_b"))])
    if key is None:
        keyed = stored(keyed.withColumn("_row", F.monotonically_increasing_id()))
    side = F.explode(F.array(*[F.struct(F.col(k).alias("text_key"), F.col(c).alias("content"))
                               for c, k in ((anchor, "_a"), (positive, "_b"))]))
    texts = (keyed.select(side.alias("_t")).select("_t.*").filter("text_key is not null")
             .groupBy("text_key").agg(F.min("content").alias("content")))
    probs = stored(classify(texts).select("text_key", "probs"))
    ids = stored(keyed.select(row, "_a", "_b"))
    found = ids
    for k, name in (("_a", "anchor_probs"), ("_b", "positive_probs")):
        found = lookup(found, probs.select(F.col("text_key").alias(k), F.col("probs").alias(name)), [k], "left", counted=ids.select(k))
    out = keyed.drop("_a", "_b").join(found.drop("_a", "_b"), row, "left")
    return out.select(*names, "anchor_probs", "positive_probs")


def node_center_scores(pairs: DataFrame, node_probs: DataFrame, center_probs: DataFrame,
                       method: str = "confidence_weighted_dot_product") -> DataFrame:
    """Scored node/centre pairs, one row per pair of `node_center_pairs`; none is lost.

    `node_probs`: post_id, node_id, probs. `center_probs`: post_id, root_id, probs, one row per subtree, so a centre
    is classified once however many nodes it has. A node or centre without probabilities scores 0.
    """
    nodes = node_probs.select("post_id", "node_id", F.col("probs").alias("anchor_probs"))
    centers = center_probs.select("post_id", "root_id", F.col("probs").alias("positive_probs"))
    both = lookup(pairs.join(nodes, ["post_id", "node_id"], "left"), centers, ["post_id", "root_id"], "left",
                  counted=pairs.select("post_id", "root_id"))
    return score_pairs(both, method)


def score_statistics(scored: DataFrame) -> DataFrame:
    """Count, mean, population std, range and exact quantiles of the scores."""
    s = "consistency_score"
    plain = scored.agg(F.count(s).alias("count"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
                       F.min(s).alias("min"), F.max(s).alias("max"))
    q = exact_quantiles(scored, s, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95})
    return beside(plain, q)


def noise_group(score: str, mode: str, threshold: float, bins) -> Column:
    """Name of the group of targets a score belongs to, null if none."""
    s = F.col(score)
    if mode == "all_above_threshold":
        return F.when(s >= threshold, F.lit(f">={threshold:.2f}"))
    if bins is None:
        bins = [(threshold, 0.6), (0.6, 0.8), (0.8, 1.0)]
    name = F.lit(None).cast("string")
    for lo, hi in reversed(bins):
        name = F.when((s >= lo) & (s < hi + (SLACK if hi == 1.0 else 0.0)), F.lit(f"{lo:.2f}-{hi:.2f}")).otherwise(name)
    return name


def noise_pool(scored: DataFrame, pool: tuple[float, float]) -> DataFrame:
    """The low-scoring pairs that replace others."""
    return scored.filter(F.col("consistency_score").between(pool[0], pool[1] + SLACK))


CONTENT = ["anchor_content", "positive_content", "anchor_probs", "positive_probs", "consistency_score"]


def inject_noise(scored: DataFrame, fraction: float, pool: tuple[float, float] = (0.0, 0.01),
                 threshold: float = 0.4, mode: str = "by_bins", bins=None, seed: int = 42) -> DataFrame:
    """Replace a share of the high-scoring pairs by pairs from the low-scoring pool.

    ceil(fraction * n) targets per score bin (or of all above the threshold) take text, probabilities
    and score of a pool row. Targets and pool rows are numbered in hash order and joined on
    `target mod pool size`, so the pool is used without replacement and starts over when exhausted.
    Pool rows are copied as they were before any replacement. The row keeps its own `sample_index`;
    the struct `noise` tells what happened and is NULL on untouched rows. `scored` should be a stored
    table: its scores are read for the targets, its pool rows twice, and all of it once. Targets are numbered once,
    in a stored table of ids.
    """
    fields = "struct<injected:boolean,original_score:double,replacement_score:double,source_index:bigint,group:string>"
    if fraction <= 0:
        return scored.withColumn("noise", F.lit(None).cast(fields))
    named = scored.select("sample_index", "consistency_score",
                          noise_group("consistency_score", mode, threshold, bins).alias("_group"))
    targets = hash_rank(named.filter(F.col("_group").isNotNull()), ["_group"], ["sample_index"], seed, "_r", "_n")
    targets = stored(targets.filter(F.col("_r") <= F.ceil(F.col("_n") * F.lit(float(fraction)))))
    numbered = stored(dense_index(targets.select("sample_index", "_group", F.col("consistency_score").alias("_original")),
                                  ["sample_index"], f"{seed}:target", "_t"))
    source = noise_pool(scored, pool)
    size = source.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = dense_index(source.select(F.col("sample_index").alias("_source"),
                                     *[F.col(c).alias(f"_new_{c}") for c in CONTENT]),
                       ["_source"], f"{seed}:pool", "_p")
    filled = lookup(numbered.withColumn("_p", F.try_mod("_t", size)).filter("_p is not null"), rows, ["_p"])
    filled = filled.select("sample_index", "_source", "_group", "_original", *[f"_new_{c}" for c in CONTENT])
    hit = F.col("_source").isNotNull()
    noise = F.when(hit, F.struct(F.lit(True).alias("injected"), F.col("_original").alias("original_score"),
                                 F.col("_new_consistency_score").alias("replacement_score"),
                                 F.col("_source").alias("source_index"), F.col("_group").alias("group")))
    joined = scored.join(filled, "sample_index", "left")
    return joined.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in CONTENT else c
                           for c in scored.columns], noise.alias("noise"))


def noise_breakdown(noisy: DataFrame) -> DataFrame:
    """Replaced rows per score group."""
    return noisy.filter("noise is not null").groupBy(F.col("noise.group").alias("group")).agg(
        F.count(F.lit(1)).alias("count"))


def noise_status(scored: DataFrame, noisy: DataFrame, fraction: float, pool: tuple[float, float] = (0.0, 0.01),
                 mode: str = "by_bins", bins=None) -> DataFrame:
    """One row: what the injection did, or why it did nothing."""
    available = noise_pool(scored, pool).select(F.count(F.lit(1)).alias("n")).scalar()
    done = noisy.agg(F.count_if(F.col("noise").isNotNull()).alias("total_replaced"))
    no_groups = F.lit(mode != "all_above_threshold" and bins is not None and len(bins) == 0)
    status = (F.when(F.lit(fraction <= 0), F.lit("skipped_fraction_0"))
              .when(F.col("pool_size") == 0, F.lit("skipped_empty_pool"))
              .when(no_groups, F.lit("skipped_empty_targets"))
              .when(F.col("total_replaced") == 0, F.lit("skipped_no_replacements")).otherwise(F.lit("applied")))
    return done.select("total_replaced", available.alias("pool_size")).select(
        status.alias("status"), "total_replaced", "pool_size")


def _interval(score: str) -> Column:
    s = F.col(score)
    name = F.lit(None).cast("string")
    for label, lo, hi in REVIEW:
        inside = (s >= lo) & ((s <= hi) if hi == 1.0 else (s < hi))
        name = F.when(inside, F.lit(label)).otherwise(name)
    return name


def review_sample(scored: DataFrame, per_interval: int = 50, seed: int = 42) -> DataFrame:
    """Up to n pairs per score interval with empty columns for human marks; sort by score descending."""
    rows = scored.withColumn("category", _interval("consistency_score")).filter("category is not null")
    picked = take_by_hash(rows, ["category"], ["sample_index"], per_interval, seed)
    return picked.select(
        "sample_index", F.round("consistency_score", 4).alias("consistency_score"), "category", "dataset_type",
        preview("anchor_content").alias("anchor_text"), preview("positive_content").alias("positive_text"),
        F.lit("").alias("human_score"), F.lit("").alias("remark")).orderBy(F.desc("consistency_score"), "sample_index")


def review_counts(scored: DataFrame) -> DataFrame:
    """Pairs per score interval."""
    rows = scored.select(_interval("consistency_score").alias("category")).filter("category is not null")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
