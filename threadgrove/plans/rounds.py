"""The curation round: scored pairs in, weighted pairs with history out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadgrove.functions.rows import beside
from threadgrove.operators.ranking import dense_index, hash_rank
from threadgrove.operators.scoring import attach_probabilities, inject_noise, noise_group, noise_pool, score_pairs
from threadgrove.operators.weights import append_history, by_tier, effective_threshold, weights
from threadgrove.session import stored

HISTORY = ["training_rounds", "filter_history", "last_trained_round"]


def carry_history(scored: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Bring the history columns of the earlier table along, by `sample_index`."""
    if previous is None:
        return scored
    kept = [c for c in HISTORY if c in previous.columns]
    return scored.drop(*kept).join(previous.select("sample_index", *kept), "sample_index", "left")


def curation_round(pairs: DataFrame, round_num: int, strategy: str = "linear", threshold: float = 0.3,
                   method: str = "confidence_weighted_dot_product", noise: dict | None = None,
                   previous: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Score, optionally inject noise, weight, and record the round.

    `noise` holds the arguments of `inject_noise`. Weighting and noise injection read the scores several times, so
    the scored pairs are stored once, unless `pairs` is a `written` table: a score is then worked out again where it
    is read, without the texts.
    """
    scored = score_pairs(pairs, method)
    scored = scored if written else stored(scored)
    again = "noise" in scored.columns  # rows replaced in an earlier round stay replaced
    if again:
        scored = scored.withColumnRenamed("noise", "_noise_before")
    scored = inject_noise(scored, **(noise or {"fraction": 0.0}))  # always with the column `noise`
    if again:
        scored = scored.withColumn("noise", F.coalesce("noise", "_noise_before")).drop("_noise_before")
    weighted = weights(carry_history(scored, previous), strategy, threshold)
    return append_history(weighted, round_num, strategy, threshold)


def write_round(df: DataFrame, path: str, round_num: int, variant: str = "main") -> None:
    """Write one (round, variant) partition; running it again replaces only that partition."""
    (df.withColumn("round", F.lit(round_num)).withColumn("variant", F.lit(variant)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("round", "variant").parquet(path))


def read_round(spark, path: str, round_num: int, variant: str = "main") -> DataFrame:
    """The rows of one round; only its partition is read."""
    return (spark.read.parquet(path).filter((F.col("round") == round_num) & (F.col("variant") == variant))
            .drop("round", "variant"))


def run_rounds(pairs: DataFrame | None, path: str, settings: list[dict], variant: str = "main", start: int = 1,
               spark: SparkSession | None = None) -> DataFrame:
    """Run rounds `start`, `start` + 1, … one after the other and return the last one.

    The first round works on `pairs`, every later one on the table the round before wrote, with its texts, noise
    and history. A run that starts later resumes from the written round `start` - 1 and takes no pairs (but `spark`).
    `settings` holds the arguments of `curation_round` per round, and may hold `classify`, the classifier of that
    round for `attach_probabilities`, and `noise_copy`: arguments of `inject_noise` for a copy that is only written
    for evaluation, as variant 'noise_eval', while the round itself stays without that noise.
    """
    spark = spark or pairs.sparkSession
    table = pairs if start == 1 else read_round(spark, path, start - 1, variant)
    for n, chosen in enumerate(settings, start=start):
        given = {k: v for k, v in chosen.items() if k not in ("classify", "noise_copy")}
        if "classify" in chosen:
            table = stored(attach_probabilities(table, chosen["classify"], key="sample_index" if n > 1 else None))
        elif n == 1:
            table = stored(table)
        write_round(curation_round(table, n, **given, written=True), path, n, variant)
        if "noise_copy" in chosen:
            write_round(curation_round(table, n, **{**given, "noise": chosen["noise_copy"]}, written=True), path, n, "noise_eval")
        table = read_round(spark, path, n, variant)
    return table


# fixed values: the variants compared by default
DEFAULT_VARIANTS = [("linear", 0.0), ("threshold", 0.3), ("threshold", 0.5), ("threshold", 0.7)]


def variant_sweep(scored: DataFrame, variants=None) -> DataFrame:
    """Kept pairs and weight figures for several (strategy, threshold) settings in one pass, with `variant`, the
    number of the setting: two settings may come to the same threshold.

    Every scored pair is expanded to the short list of settings and reduced by partial aggregation;
    the rule for "nothing passes" is applied to the sums.
    """
    chosen = [(s, effective_threshold(s, t) if s != "tiered" else float(t)) for s, t in (variants or DEFAULT_VARIANTS)]
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_variant"), F.lit(s).alias("strategy"), F.lit(t).alias("threshold")) for i, (s, t) in enumerate(chosen)]))
    known = F.when(~F.isnan("consistency_score"), F.col("consistency_score"))  # a NaN score passes nowhere
    rows = scored.select(known.alias("_s"), each.alias("_v")).select("_s", "_v.*")
    s = F.col("_s")
    tier = by_tier(s, lambda t: t[1] if t else 0.0)
    passed = F.when(F.col("strategy") == "tiered", tier > 0).otherwise(s >= F.col("threshold"))
    weight = F.when(F.col("strategy") == "tiered", tier).when(F.col("strategy") == "linear", s).otherwise(F.lit(1.0))
    sums = rows.groupBy("_variant", "strategy", "threshold").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("_passed"),
        F.count_if(passed & (weight > 0)).alias("_kept"), F.sum(F.when(passed, weight)).alias("_sum"),
        F.count_if(weight > 0).alias("_all_kept"), F.sum(weight).alias("_all_sum"))
    fallback = (F.col("_passed") == 0) & (F.col("strategy") != "tiered")
    kept = F.when(fallback, F.col("_all_kept")).otherwise(F.col("_kept"))
    mass = F.when(fallback, F.col("_all_sum")).otherwise(F.coalesce("_sum", F.lit(0.0)))
    return sums.select(F.col("_variant").alias("variant"), "strategy", "threshold", "total", kept.alias("kept"),
                       (kept / F.col("total")).alias("keep_ratio"), (mass / F.col("total")).alias("mean_weight"),
                       F.try_divide(mass, kept).alias("mean_kept_weight"))


def noise_sweep(scored: DataFrame, fractions, pool: tuple[float, float] = (0.0, 0.01), threshold: float = 0.4,
                mode: str = "by_bins", bins=None, seed: int = 42) -> DataFrame:
    """fraction, total, replaced, mean_score of `inject_noise` for several fractions, without injecting.

    The targets of every fraction are a prefix of one ranking, and the pool rows that they take are whole rounds of the
    pool and a prefix of it. So one ranking of the targets, one of the pool and a sum per fraction over
    either give all rows; their number does not grow with the fractions.
    """
    s, chosen = F.col("consistency_score"), [float(f) for f in fractions]
    named = scored.select("sample_index", "consistency_score", noise_group("consistency_score", mode, threshold, bins).alias("_group"))
    ranked = hash_rank(named.filter(F.col("_group").isNotNull()), ["_group"], ["sample_index"], seed, "_r", "_n")
    others = named.filter(F.col("_group").isNull()).withColumns({"_r": F.lit(None).cast("bigint"), "_n": F.lit(None).cast("bigint")})
    hit = [F.coalesce(F.col("_r") <= F.ceil(F.col("_n") * F.lit(f)), F.lit(False)) for f in chosen]
    targets = stored(ranked.unionByName(others).agg(
        F.count(F.lit(1)).alias("total"), F.array(*[F.count_if(h) for h in hit]).alias("replaced"),
        F.array(*[F.count(F.when(~h, s)) for h in hit]).alias("untouched"),
        F.array(*[F.coalesce(F.sum(F.when(~h, s)), F.lit(0.0)) for h in hit]).alias("untouched_sum"),
        F.count(s).alias("scores"), F.sum(s).alias("score_sum")))
    rows = dense_index(noise_pool(scored, pool).select(F.col("sample_index").alias("_source"), s), ["_source"], f"{seed}:pool", "_p")
    size = noise_pool(scored, pool).select(F.count(F.lit(1)).alias("n")).scalar()
    placed = rows.withColumns({"_replaced": targets.select("replaced").scalar(), "_size": size})
    taken = placed.withColumn("_rest", F.transform("_replaced", lambda k: F.try_mod(k, F.col("_size")))).agg(
        F.count(F.lit(1)).alias("pool"), F.sum(s).alias("pool_sum"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_p") < F.get("_rest", F.lit(i)), s)), F.lit(0.0)) for i in range(len(chosen))]).alias("prefix"))
    each = beside(targets, taken).select("total", "scores", "score_sum", "pool", "pool_sum", F.posexplode(F.arrays_zip(
        F.array(*[F.lit(f) for f in chosen]).alias("fraction"), "replaced", "untouched", "untouched_sum", "prefix")).alias("_i", "_v"))
    v = F.col("_v")
    drawn = F.floor(F.try_divide(v["replaced"], F.col("pool"))) * F.col("pool_sum") + v["prefix"]
    mean = F.when(F.col("pool") == 0, F.try_divide("score_sum", "scores")).when(v["replaced"] == 0, F.try_divide("score_sum", "scores")).otherwise(
        (v["untouched_sum"] + drawn) / (v["untouched"] + v["replaced"]))
    return each.select(v["fraction"].alias("fraction"), "total", F.when(F.col("pool") == 0, F.lit(0)).otherwise(v["replaced"]).alias("replaced"),
                       mean.alias("mean_score"))
