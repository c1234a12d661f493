"""Agreement of two class-probability arrays, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadgrove.functions.vectors import dot_expr, let, norm_expr, total

EPSILON = 1e-8  # fixed value: added to probabilities before taking logs


def softmax(logits) -> Column:
    """Class probabilities of logits, shifted by the maximum."""
    x = F.col(logits) if isinstance(logits, str) else logits
    powers = let(x, lambda a: let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp((v - top).cast("double")))))
    return let(powers, lambda p: let(total(p), lambda s: F.transform(p, lambda v: v / s)))


def confidence(p) -> Column:
    """1 - entropy / log(number of classes); NULL for a single class."""
    entropy = -total(F.transform(p, lambda v: (v + EPSILON) * F.log(v + EPSILON)))
    return F.lit(1.0) - F.try_divide(entropy, F.log(F.size(p).cast("double")))


def confidence_weighted_dot(p, q) -> Column:
    return dot_expr(p, q) * confidence(p) * confidence(q)


def symmetric_kl(p, q) -> Column:
    """exp of minus the mean of both Kullback-Leibler divergences."""
    gap = F.zip_with(p, q, lambda a, b: (a - b) * (F.log(a + EPSILON) - F.log(b + EPSILON)))
    return F.exp(-total(gap) / 2)


def shifted_cosine(p, q) -> Column:
    norms = norm_expr(p) * norm_expr(q)
    return F.when(norms == 0, F.lit(0.0)).otherwise((F.try_divide(dot_expr(p, q), norms) + 1) / 2)


def simple_dot(p, q) -> Column:
    return dot_expr(p, q)


def agreement(p, q) -> Column:
    """Smaller of the two top probabilities when both sides predict the same class, else 0."""
    same = F.array_position(p, F.array_max(p)) == F.array_position(q, F.array_max(q))
    return F.when(same, F.least(F.array_max(p), F.array_max(q))).otherwise(F.lit(0.0))


METHODS = {
    "confidence_weighted_dot_product": confidence_weighted_dot,
    "kl_divergence": symmetric_kl,
    "cosine_similarity": shifted_cosine,
    "simple_dot_product": simple_dot,
    "prediction_agreement": agreement,
}  # fixed names: the scoring methods a user can ask for


def consistency(p, q, method: str = "confidence_weighted_dot_product") -> Column:
    """Consistency score by method name; 0 when either side has no probabilities."""
    if method not in METHODS:
        raise ValueError(f"unknown consistency method: {method}")
    p, q = [F.col(c) if isinstance(c, str) else c for c in (p, q)]
    return F.when(p.isNull() | q.isNull(), F.lit(0.0)).otherwise(METHODS[method](p, q))
