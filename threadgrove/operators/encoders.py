"""Comparison of encoders from their metrics: one row per encoder, a handful of encoders.

`encoder_metrics`: encoder, round (NULL for baselines), is_baseline, and metric columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.operators.ranking import best_per_group

LOWER_IS_BETTER = ["inter_sim"]  # fixed values: metric directions, trend labels and note limits
TREND_LABELS = {"intra_sim": "Intra up", "inter_sim": "Inter down", "margin": "Margin up",
                "nmi": "NMI up", "acc": "ACC up", "ari": "ARI up"}
NOTES = [("intra_sim", 0.05, "Intra up"), ("inter_sim", -0.05, "Inter down"), ("margin", 0.1, "Strong improvement")]


def encoder_comparison(long: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide table from (encoder, metric, value)."""
    return long.groupBy("encoder").pivot("metric", metrics).agg(F.first("value"))


def sorted_by(wide: DataFrame, metric: str) -> DataFrame:
    """Encoders by one metric, best first; ties by name."""
    order = F.asc(metric) if metric in LOWER_IS_BETTER else F.desc(metric)
    return wide.orderBy(order, "encoder")


def best_encoders(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Best encoder per metric; the first name wins ties."""
    long = wide.unpivot(["encoder"], metrics, "metric", "value").filter(F.col("value").isNotNull())
    gain = F.when(F.col("metric").isin(LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    return best_per_group(long, ["metric"], [gain.desc(), F.asc("encoder")])


def improvement(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Change in percent of every non-baseline encoder over every baseline, per metric."""
    long = wide.unpivot(["encoder", "is_baseline"], metrics, "metric", "value")
    base = long.filter("is_baseline").select("metric", F.col("encoder").alias("baseline"), F.col("value").alias("_b"))
    return long.filter(~F.col("is_baseline")).join(base, "metric").select(
        "baseline", "encoder", "metric",
        (F.try_divide(F.col("value") - F.col("_b"), F.col("_b")) * 100).alias("improvement_percentage"))


def _rounds(wide: DataFrame) -> tuple[DataFrame, object]:
    return wide.filter(F.col("round").isNotNull()), Window.partitionBy(F.lit(0)).orderBy("round")


def _labels(parts: list[Column], empty: str) -> Column:
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", F.lit(empty)).otherwise(text)


def round_trend(wide: DataFrame, metrics: tuple[str, ...] = ("intra_sim", "inter_sim", "margin")) -> DataFrame:
    """Which metrics got better than in the round before."""
    rows, w = _rounds(wide)
    marks = []
    for m in metrics:
        before = F.lag(m).over(w)
        better = F.col(m) < before if m in LOWER_IS_BETTER else F.col(m) > before
        marks.append(F.when(better, F.lit(TREND_LABELS[m])))
    return rows.select("round", *metrics, _labels(marks, "-").alias("trend"))


def round_delta(wide: DataFrame) -> DataFrame:
    """Change against the first round, with notes."""
    rows, w = _rounds(wide)
    first = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deltas = {m: F.col(m) - F.first_value(m).over(first) for m, _, _ in NOTES}
    start = F.col("round") == F.first_value("round").over(first)
    notes = [F.when(F.col(f"{m}_delta") > t if t > 0 else F.col(f"{m}_delta") < t, F.lit(n)) for m, t, n in NOTES]
    return rows.select("round", start.alias("_start"), *[d.alias(f"{m}_delta") for m, d in deltas.items()]).select(
        "round", *[f"{m}_delta" for m in deltas],
        F.when(F.col("_start"), F.lit("Baseline")).otherwise(_labels(notes, "-")).alias("note"))
