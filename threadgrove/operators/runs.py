"""Tables about tables of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.functions.text import fraction_of
from threadgrove.operators.ranking import best_per_group
from threadgrove.operators.skew import lookup

# fixed values: metric columns of a run
TEST_METRICS = ["test_accuracy", "test_f1", "test_precision", "test_recall"]
SEED_METRICS = ["test_f1", "test_accuracy", "test_precision", "test_recall", "val_f1"]
CONFIG = ["model_name", "classifier_type", "mlp_hidden_neurons", "freeze_encoder", "epochs", "batch_size",
          "learning_rate", "data_fraction"]
TARGET_FRACTIONS = [1.0, 0.5, 0.2, 0.1, 0.05]


def by_model_fraction(runs: DataFrame) -> DataFrame:
    """Runs with their group key `<model>_frac<fraction>`."""
    return runs.withColumn("model_fraction", F.concat("model_name", F.lit("_frac"), F.col("data_fraction").cast("string")))


def group_runs(runs: DataFrame) -> DataFrame:
    """Runs per key: their number, the number of seeds, and the run indexes in order.

    The list holds one number per repetition of one configuration, which the user of the grid sets.
    """
    return runs.groupBy("model_fraction").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("seed").alias("seeds"),
        F.sort_array(F.collect_list("run_idx")).alias("run_indexes"))


def _best_first() -> list[Column]:
    return [F.desc_nulls_last("val_f1"), F.asc("run_idx")]


def best_runs(runs: DataFrame) -> DataFrame:
    """Best run per (model, fraction) by validation F1; the smaller run index wins ties."""
    return best_per_group(runs, ["model_name", "data_fraction"], _best_first())


def best_run(runs: DataFrame) -> DataFrame:
    """The best run of all."""
    return runs.orderBy(*_best_first()).limit(1)


def comparison(best: DataFrame, metric: str = "test_f1", models: list[str] | None = None) -> DataFrame:
    """fraction x model table of one metric, rounded to 4 digits; missing cells are NULL."""
    return best.groupBy("data_fraction").pivot("model_name", models).agg(F.round(F.first(metric), 4))


def _unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def best_overall(best: DataFrame) -> DataFrame:
    """Best run per test metric, or by validation F1 while any best run lacks test metrics."""
    tested = best.select(F.coalesce(F.bool_and(F.col("test_f1").isNotNull()), F.lit(False)).alias("t")).scalar()
    long = _unpivot(best, ["run_idx", "model_name", "data_fraction"], [*TEST_METRICS, "val_f1"])
    wanted = long.filter((F.col("metric") != "val_f1") == tested)
    return best_per_group(wanted, ["metric"], [F.desc_nulls_last("value"), F.asc("run_idx")])


def fraction_trend(best: DataFrame) -> DataFrame:
    """F1 and accuracy of every model along decreasing data fractions."""
    w = Window.partitionBy("model_name").orderBy(F.desc("data_fraction"))  # one row per fraction
    return best.select("model_name", F.row_number().over(w).cast("bigint").alias("step"), "data_fraction",
                       "test_f1", "test_accuracy")


def config_summary(runs: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over seeds per configuration; runs without test metrics are left out."""
    width = F.when(F.col("classifier_type") == "mlp", F.col("mlp_hidden_neurons")).otherwise(F.lit(0))
    rows = runs.filter(F.col("test_f1").isNotNull()).withColumn("mlp_hidden_neurons", width)
    return rows.groupBy(*CONFIG).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in TEST_METRICS], *[F.stddev_samp(m).alias(f"{m}_std") for m in TEST_METRICS],
        F.count(F.lit(1)).alias("num_runs"))


def seed_stats(runs: DataFrame, key: str = "model_fraction") -> DataFrame:
    """Mean, population std, minimum and maximum per metric, and the number of runs."""
    figures = [("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)]
    return runs.groupBy(key).agg(*[f(m).alias(f"{m}_{n}") for m in SEED_METRICS for n, f in figures],
                                 F.count(F.lit(1)).alias("num_seeds"))


def closest_to_mean(runs: DataFrame, metric: str = "test_f1", key: str = "model_fraction") -> DataFrame:
    """Per key the run whose metric is nearest to the mean; the smaller run index wins ties.

    The mean comes from an aggregation that is joined back, so no group is held in one window.
    """
    means = runs.groupBy(key).agg(F.avg(metric).alias("mean_value"))
    rows = lookup(runs.filter(F.col(metric).isNotNull()), means, [key], counted=runs).withColumn(
        "distance_to_mean", F.abs(F.col(metric) - F.col("mean_value")))
    return best_per_group(rows, [key], [F.asc("distance_to_mean"), F.asc("run_idx")])


def select_for_fractions(runs: DataFrame, fractions: list[float] | None = None, metric: str = "test_f1",
                         key: str = "model_fraction") -> DataFrame:
    """Closest-to-mean run and seed statistics of the keys whose data fraction is wanted."""
    wanted = runs.filter(fraction_of(key).isin([float(f) for f in fractions or TARGET_FRACTIONS]))
    chosen = closest_to_mean(wanted, metric, key).select(
        key, fraction_of(key).alias("fraction"), "seed", "run_idx", F.col(metric).alias("selected_value"),
        "mean_value", "distance_to_mean")
    return chosen.join(seed_stats(wanted, key), key)


def grid_summary(runs: DataFrame) -> DataFrame:
    """Counts of all, successful and failed runs, and the best successful one."""
    ok = F.col("status") == "success"
    best = F.max(F.when(ok, F.struct("val_f1", (-F.col("run_idx")).alias("_r"))))
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("successful_runs"),
                    F.count_if(~ok).alias("failed_runs"), best.alias("_b")).select(
        "total_runs", "successful_runs", "failed_runs", (-F.col("_b._r")).alias("best_run_idx"),
        F.col("_b.val_f1").alias("best_val_f1"))


def grid_rows(runs: DataFrame) -> DataFrame:
    """One flat row per run; the metric of a failed run reads FAILED."""
    ok = F.col("status") == "success"
    return runs.select("run_idx", "model_name", "data_fraction", "seed",
                       F.when(ok, F.format_number("val_f1", 4)).otherwise(F.lit("FAILED")).alias("val_f1"), "status")
