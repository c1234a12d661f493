"""Vector arithmetic as columns.

`cosine`, `dot` and `unit` ship whole Arrow batches to numpy; `cosine_expr` and `dot_expr` stay in
the JVM as higher-order functions. Both give NULL when a vector is missing and NaN when a norm is
zero, so that "missing" and "undefined" stay apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Dense float64 matrix of a list array without nulls; all rows must have one length."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(vectors), -1)


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """L2-normalised float64 matrix of a vector column; zero vectors stay zero."""
    x = _matrix(column.combine_chunks())
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _pairwise(a: pa.Array, b: pa.Array, f) -> pa.Array:
    present = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    out = np.zeros(len(a))
    if present.any():
        keep = pa.array(present)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[present] = f(_matrix(a.filter(keep)), _matrix(b.filter(keep)))
    return pa.array(out, mask=~present)


@F.arrow_udf(T.DoubleType())
def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    def f(x, y):
        norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return np.einsum("ij,ij->i", x, y) / np.where(norms == 0, np.nan, norms)

    return _pairwise(a, b, f)


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairwise(a, b, lambda x, y: np.einsum("ij,ij->i", x, y))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _unit(a: pa.Array) -> pa.Array:
    present = a.is_valid()
    x = _matrix(a.filter(present)) if len(a) else np.zeros((0, 0))
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    rows = iter(x / np.where(norms == 0, 1.0, norms))
    return pa.array([next(rows) if ok else None for ok in present.to_pylist()], pa.list_(pa.float64()))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cosine(a, b) -> Column:
    """Cosine similarity in double precision."""
    return _cosine(_c(a), _c(b))


def dot(a, b) -> Column:
    return _dot(_c(a), _c(b))


def unit(a) -> Column:
    """L2-normalised vector; the zero vector stays zero."""
    return _unit(_c(a))


def total(values) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(_c(values), F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot_expr(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm_expr(a) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_expr(a, b) -> Column:
    norms = norm_expr(a) * norm_expr(b)
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot_expr(a, b), norms))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def logsumexp(values) -> Column:
    """Stable log of a sum of exponentials over an array of doubles."""
    return let(F.array_max(_c(values)), lambda top: top + F.log(total(F.transform(_c(values), lambda x: F.exp(x - top)))))


def mean_vector(df: DataFrame, keys: list[str], vec: str = "embedding", mask: str | None = None,
                out: str = "center") -> DataFrame:
    """Mean vector per key, with an optional 0/1 mask column; keys without a counted vector drop out.

    The running sum is one fixed-size buffer per key and map task, so a hot key costs nothing extra.
    """
    weight = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = df.filter(F.col(vec).isNotNull() & (weight > 0))
    mean = Summarizer.metrics("mean").summary(array_to_vector(F.col(vec)), weight).getField("mean")
    return rows.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def first_vector(df: DataFrame, keys: list[str], order: str, vec: str = "embedding",
                 out: str = "center") -> DataFrame:
    """Vector with the smallest order value per key (first-token pooling)."""
    return df.groupBy(*keys).agg(F.min_by(vec, order).alias(out))
