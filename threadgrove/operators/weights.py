"""Scores to sample weights, the pool of filtered pairs, and the per-round history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadgrove import schemas
from threadgrove.functions.hashing import portable_hash
from threadgrove.operators.ranking import dense_index
from threadgrove.operators.skew import lookup

DEFAULT_THRESHOLD = 0.4  # fixed values
TIERS = [(0.0, 0.4, 0.0), (0.4, 0.6, 0.5), (0.6, 0.8, 0.7), (0.8, 1.0, 0.9)]
STRATEGIES = ("linear", "threshold", "tiered")


def effective_threshold(strategy: str, threshold) -> float:
    """The threshold, or 0.4 when it is not a number in [0, 1) (linear) or [0, 1] (threshold)."""
    try:
        t = float(threshold) if threshold is not None else DEFAULT_THRESHOLD
    except (TypeError, ValueError):
        return DEFAULT_THRESHOLD
    inside = 0 <= t < 1 if strategy == "linear" else 0 <= t <= 1
    return t if inside else DEFAULT_THRESHOLD


def by_tier(value: Column, pick) -> Column:
    """`pick` of (number, weight) of the tier that holds the value, `pick(None)` outside all tiers."""
    out = F.lit(pick(None))
    for i, (lo, hi, w) in enumerate(TIERS):
        inside = (value >= lo) & ((value <= hi) if hi == 1.0 else (value < hi))
        out = F.when(inside, F.lit(pick((i + 1, w)))).otherwise(out)
    return out


def weights(scored: DataFrame, strategy: str = "linear", threshold=0.3) -> DataFrame:
    """Add `sample_weight`. When no score reaches the threshold, nothing is filtered.

    Whether any score passes is one scalar over the score column alone.
    """
    s = F.col("consistency_score")
    if strategy == "tiered":
        return scored.withColumn("sample_weight", by_tier(s, lambda t: t[1] if t else 0.0))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown weighting strategy: {strategy}")
    t = effective_threshold(strategy, threshold)
    passed = (s >= t) & ~F.isnan(s)
    some = scored.select(F.coalesce(F.bool_or(passed), F.lit(False)).alias("p")).scalar()
    weight = s if strategy == "linear" else F.lit(1.0)
    return scored.withColumn("sample_weight", F.when(passed | ~some, weight).otherwise(F.lit(0.0)))


def tier_counts(scored: DataFrame) -> DataFrame:
    """Pairs per tier with their share of all pairs; scores outside [0, 1] are tier 0."""
    tier = by_tier(F.col("consistency_score"), lambda t: t[0] if t else 0)
    n = scored.select(F.count(F.lit(1)).alias("n")).scalar()
    return scored.groupBy(tier.cast("bigint").alias("tier")).agg(F.count(F.lit(1)).alias("count")).withColumn(
        "percentage", F.col("count") * 100.0 / n)


def filtered_pool(weighted: DataFrame) -> DataFrame:
    """Pairs that were filtered out and may serve as negatives."""
    return weighted.filter(F.col("sample_weight") == 0).select(
        "sample_index", "anchor_content", "positive_content", "consistency_score")


def weight_summary(weighted: DataFrame) -> DataFrame:
    """Counts, weight figures, and score ranges of the kept and the filtered pairs."""
    w, s = F.col("sample_weight"), F.col("consistency_score")
    return weighted.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(w > 0).alias("effective"),
        F.min(w).alias("min_weight"), F.max(w).alias("max_weight"), F.avg(w).alias("mean_weight"),
        F.min(F.when(w > 0, s)).alias("min_kept"), F.max(F.when(w > 0, s)).alias("max_kept"),
        F.min(F.when(w == 0, s)).alias("min_filtered"), F.max(F.when(w == 0, s)).alias("max_filtered"))


def append_history(weighted: DataFrame, round_num: int, strategy: str, threshold: float) -> DataFrame:
    """Record this round in `training_rounds`, `filter_history` and `last_trained_round`.

    A round that is recorded again replaces its own entry.
    """
    key = F.lit(f"round_{round_num}")
    trained = F.col("sample_weight") > 0
    df = weighted
    for name, t in (("training_rounds", schemas.TRAINING_ROUNDS), ("filter_history", schemas.FILTER_HISTORY)):
        if name not in df.columns:
            df = df.withColumn(name, F.create_map().cast(t))
    if "last_trained_round" not in df.columns:
        df = df.withColumn("last_trained_round", F.lit(None).cast("int"))
    entry = F.struct(F.lit(strategy).alias("strategy"), F.lit(float(threshold)).alias("threshold"),
                     F.col("consistency_score"), F.col("sample_weight").alias("weight"), trained.alias("passed"))

    def put(name: str, value: Column) -> Column:
        others = F.map_filter(F.coalesce(F.col(name), F.create_map().cast(dict(
            training_rounds=schemas.TRAINING_ROUNDS, filter_history=schemas.FILTER_HISTORY)[name])), lambda k, _: k != key)
        return F.map_concat(others, F.create_map(key, value))

    return df.withColumns({
        "training_rounds": put("training_rounds", trained), "filter_history": put("filter_history", entry),
        "last_trained_round": F.when(trained, F.lit(round_num)).otherwise(F.col("last_trained_round"))})


def round_info(weighted: DataFrame, round_num: int, strategy: str, threshold: float) -> DataFrame:
    """One row about this round; append it to the table of the earlier rounds."""
    return weighted.agg(
        F.lit(round_num).cast("bigint").alias("round"), F.lit(strategy).alias("strategy"),
        F.lit(float(threshold)).alias("threshold"), F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("sample_weight") > 0).alias("trained_samples")).withColumn(
        "filter_ratio", F.coalesce(F.try_divide(F.col("trained_samples").cast("double"), F.col("total_samples")), F.lit(0.0)))


def filtered_negatives(batches: DataFrame, pool: DataFrame, ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """floor(batch size * ratio) texts per batch from the pool, without replacement inside a batch.

    The pool is numbered in hash order; a batch takes a run of it from a hashed start, wrapping round.
    Anchor or positive text is a hashed coin flip. `batches`: batch_id, batch_size.
    """
    rows = dense_index(pool.select("sample_index", "anchor_content", "positive_content"), ["sample_index"], seed, "_p")
    size = pool.select(F.count(F.lit(1)).alias("n")).scalar()
    wanted = F.least(F.floor(F.col("batch_size") * F.lit(ratio)), F.col("_size"))
    slots = (batches.select("batch_id", "batch_size", size.alias("_size")).filter(wanted > 0)
             .select("batch_id", "_size", F.explode(F.sequence(F.lit(0).cast("bigint"), wanted - 1)).alias("slot")))
    at = (portable_hash(f"{seed}:start", "batch_id") + F.col("slot")) % F.col("_size")
    drawn = slots.select("batch_id", "slot", at.alias("_p"))
    drawn = lookup(drawn, rows, ["_p"])  # every row of a small pool is a hot key
    heads = portable_hash(f"{seed}:side", "batch_id", "slot") % 2 == 0
    return drawn.select("batch_id", "slot", "sample_index",
                        F.when(heads, F.col("anchor_content")).otherwise(F.col("positive_content")).alias("negative_content"))


def weighted_mean(df: DataFrame, loss: str = "loss", weight: str = "sample_weight", by: str = "batch_id") -> DataFrame:
    """Sum(weight * loss) / sum(weight) over positive weights; batches without any are left out."""
    rows = df.filter(F.col(weight) > 0)
    return rows.groupBy(by).agg((F.sum(F.col(weight) * F.col(loss)) / F.sum(weight)).alias("weighted_loss"))
