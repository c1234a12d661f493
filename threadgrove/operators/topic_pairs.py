"""Same-label and other-label partners per row, and how well similarity tells them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadgrove.functions.hashing import portable_hash
from threadgrove.functions.rows import beside
from threadgrove.functions.vectors import cosine
from threadgrove.operators.ranking import hash_rank, running_totals
from threadgrove.operators.skew import lookup

SCORE_DIGITS = 9  # scores closer than this count as equal


def topic_pairs(df: DataFrame, key: str = "id", label: str = "label", vec: str = "embedding", seed: int = 42) -> DataFrame:
    """One positive and one negative partner per row: pair_id, truth (1/0), the two keys, cosine score.

    Rows get a dense place ordered by (label, hash). A partner is a hashed place inside the own label's
    range, or outside it, so both draws are one equi-join. Rows alone in their label have no positive,
    rows of the only label no negative. Rows without a label take no part.
    """
    df = df.filter(F.col(label).isNotNull())
    ranked = hash_rank(df.select(key, label, vec), [label], [key], seed, "_r", "_n")
    sizes = running_totals(df, label, {"_c": F.count(F.lit(1))})
    starts = sizes.select(label, F.col("_c_before").alias("_start"))
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    placed = lookup(ranked, starts, [label], counts=sizes.select(label, F.col("_c").alias("_n"))).withColumn("_place", F.col("_start") + F.col("_r") - 1)
    step = F.try_mod(portable_hash(f"{seed}:positive", key), F.col("_n") - 1) + 1
    positive = F.col("_start") + F.pmod(F.col("_r") - 1 + step, F.col("_n"))
    far = F.try_mod(portable_hash(f"{seed}:negative", key), total - F.col("_n"))
    negative = F.when(far >= F.col("_start"), far + F.col("_n")).otherwise(far)
    draws = placed.select(key, vec, F.explode(F.array(
        F.struct(F.lit(1).alias("truth"), positive.alias("place")),
        F.struct(F.lit(0).alias("truth"), negative.alias("place")))).alias("_d")).filter("_d.place is not null")
    partner = placed.select(F.col("_place").alias("_to"), F.col(key).alias("partner"), F.col(vec).alias("_pv"))
    # a row that is the only one of another label than most is drawn by very many: a hot key
    wanted = draws.select(key, vec, "_d.truth", F.col("_d.place").alias("_to"))
    joined = lookup(wanted, partner, ["_to"], counted=wanted.select("_to"))
    return joined.select(F.concat_ws("-", key, "truth").alias("pair_id"), "truth", key, "partner",
                         F.round(cosine(vec, "_pv"), SCORE_DIGITS).alias("score"))


def pair_metrics(scored: DataFrame, ks: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """One row: AUC, best accuracy with its threshold, and precision among the k highest scores.

    AUC and accuracy come from exact prefix counts over the distinct scores (ties count one half).
    """
    t = running_totals(scored, "score", {"pos": F.count_if(F.col("truth") == 1), "neg": F.count_if(F.col("truth") == 0)})
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    hit = (F.col("pos_all") - F.col("pos_before") + F.col("neg_before")) / (F.col("pos_all") + F.col("neg_all"))
    curve = t.withColumn("_hit", hit)
    best = F.max(F.struct(F.col("_hit"), (-F.col("score")).alias("_t")))
    out = curve.agg(
        F.try_divide(area, F.max(F.col("pos_all")).cast("double") * F.max("neg_all")).alias("auc"), best.alias("_b"),
        (F.max("neg_all") / (F.max("pos_all") + F.max("neg_all"))).alias("_none"))
    top = scored.orderBy(F.desc("score"), "pair_id").limit(max(ks))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "pair_id"))  # over max(ks) rows
    precision = top.withColumn("_rank", rank).agg(
        *[F.avg(F.when(F.col("_rank") <= k, F.col("truth"))).alias(f"precision_at_{k}") for k in ks])
    return beside(out, precision).select(
        "auc", F.greatest(F.col("_b._hit"), F.col("_none")).alias("accuracy"),
        F.when(F.col("_b._hit") >= F.col("_none"), -F.col("_b._t")).alias("best_threshold"),
        *[f"precision_at_{k}" for k in ks])
