"""A classifier on frozen vectors, and classification metrics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from threadgrove.session import stored


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0.

    Each confusion cell counts once for its label and once for its prediction, so one aggregation of
    the small confusion table is enough.
    """
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits"))))
    rows = confusion(df, label, prediction).select(sides.alias("_x")).select("_x.*")
    sums = rows.groupBy("c").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                 F.sum("hits").alias("hits"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = sums.withColumn("precision", ratio(F.col("hits").cast("double"), F.col("predicted"))).withColumn(
        "recall", ratio(F.col("hits").cast("double"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.select(F.col("c").alias("class"), "precision", "recall", f1.alias("f1"), "support", "hits")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro precision/recall/F1, and micro F1 (equal to accuracy)."""
    accuracy = F.sum("hits") / F.sum("support")
    return per_class_metrics(df, label, prediction).agg(
        accuracy.alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1_score"), accuracy.alias("f1_micro"))


def fit_probe(train: DataFrame, val: DataFrame, kind: str = "linear", epochs: tuple[int, ...] = (20, 100),
              regularisation: tuple[float, ...] = (0.0, 0.01), hidden: int = 32, seed: int = 42):
    """Fit on (embedding, label_id) and return (best model, its validation macro F1).

    The best setting is the one with the highest validation macro F1, the first on ties. Rows stay
    distributed; the driver sees one figure per setting.
    """
    ready = [stored(d.select("label_id", array_to_vector("embedding").alias("features"))) for d in (train, val)]
    size = ready[0].agg(F.max("label_id").alias("m")).first()["m"] + 1
    best, best_f1 = None, float("-inf")
    for n in epochs:
        for reg in (regularisation if kind == "linear" else (0.0,)):
            if kind == "linear":
                est = LogisticRegression(labelCol="label_id", maxIter=n, regParam=reg, family="multinomial")
            else:
                dim = len(ready[0].first()["features"])
                est = MultilayerPerceptronClassifier(labelCol="label_id", maxIter=n, layers=[dim, hidden, size], seed=seed)
            model = est.fit(ready[0])
            f1 = classification_metrics(model.transform(ready[1]), "label_id").first()["f1_score"]
            if f1 > best_f1:
                best, best_f1 = model, f1
    return best, best_f1


def predict(model, df: DataFrame) -> DataFrame:
    """The rows with `prediction` and the class probabilities `probs`."""
    out = model.transform(df.withColumn("features", array_to_vector("embedding")))
    return out.select(*df.columns, F.col("prediction").cast("bigint").alias("prediction"),
                      vector_to_array("probability").alias("probs"))
