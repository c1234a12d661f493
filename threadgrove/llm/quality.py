"""Naive Bayes support vectors over byte n-grams: a quality score of every document.

n-gram indicators are scaled by the log-count ratios of the two classes; a linear hinge-loss model over them is
fitted by dual coordinate descent, and a logistic curve fitted on a kept-back fifth turns margins into scores.
The fit sees a bounded sample (`SAMPLE` documents, up to half of it from either label) in one task, and the curve
weights the labels by their true sizes; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadgrove.llm.common import crc_rest, labelled_sample, utf8

SAMPLE = 8192
BITS = 17
PIECE = 1 << 20
FOLDS = 5


def gram_slots(data: np.ndarray) -> np.ndarray:
    """Hashed slots of the byte 3- and 4-grams of a text, each once, ascending. Texts of any length go piece by piece."""
    seen = np.zeros(1 << BITS, bool)
    ended = np.concatenate([[2], data, [3]]) if len(data) <= PIECE else data
    for at in range(0, len(ended), PIECE):
        x = ended[at:at + PIECE + 3].astype(np.uint32)
        if len(x) >= 3:
            three = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
            seen[(three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)] = True
            four = three[:-1] * np.uint32(0x27D4EB2F) + x[3:] * np.uint32(0x165667B1)
            seen[(four ^ (four >> np.uint32(15))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = {1: np.full(1 << BITS, smooth), -1: np.full(1 << BITS, smooth)}
    for slots, label in zip(rows, y):
        counts[int(label)][slots] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = 1.0,
                            epochs: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; the bias is the weight of a constant 1.

    The dual variable of one row at a time goes to its optimum within [0, c]; rows come in a seeded new order
    every epoch, until the largest projected gradient is below `tolerance`.
    """
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norms = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == c else gradient
            if projected:
                worst = max(worst, abs(projected))
                before = alpha[i]
                alpha[i] = min(max(before - gradient / norms[i], 0.0), c)
                w[rows[i]] += (alpha[i] - before) * y[i] * values[i]
                bias += (alpha[i] - before) * y[i]
        if worst < tolerance:
            break
    return w, bias


def fit_logistic(margins: np.ndarray, y: np.ndarray, steps: int = 100, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve from margins to probabilities, by Newton's method."""
    n = np.ones(len(y)) if weights is None else weights
    pos, neg = n[y > 0].sum(), n[y <= 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(n * (p - target) * margins).sum() + 1e-3 * a, (n * (p - target)).sum()])
        s = n * (p * (1 - p) + 1e-9)
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 0.0), float(b)


def fit(texts: list[np.ndarray], labels: np.ndarray, stands_for: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights per slot and shift, such that score = logistic(sum of a text's weights / sqrt(slots) + shift).

    `stands_for`: how many labelled documents each text stands for, 1 if not given. The margin does not depend on the
    sizes of the classes, the curve does. With one class only, or none, the weights are 0 and the shift gives the smoothed
    share of label 1.
    """
    y = np.where(np.asarray(labels) == 1, 1.0, -1.0)
    share = np.ones(len(y)) if stands_for is None else stands_for * len(y) / stands_for.sum()
    if len(set(y)) < 2:
        ones = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(ones / (1 - ones)))
    rows = [gram_slots(t) for t in texts]
    kept = np.arange(len(y)) % FOLDS == 0 if len(y) >= 50 else np.ones(len(y), bool)
    train = np.flatnonzero(~kept) if len(y) >= 50 and len(set(y[~kept])) == 2 else np.arange(len(y))
    ratios = log_count_ratios([rows[i] for i in train], y[train])
    values = [ratios[r] / np.sqrt(max(1, len(r))) for r in rows]
    w, bias = dual_coordinate_descent([rows[i] for i in train], [values[i] for i in train], y[train])
    margins = np.array([w[rows[i]] @ values[i] + bias for i in np.flatnonzero(kept)])
    slope, shift = fit_logistic(margins, y[kept], weights=share[kept])
    return (slope * w * ratios).astype(np.float32), slope * bias + shift


def train(sample: DataFrame) -> tuple[np.ndarray, float]:
    """The model from a bounded sample (doc_id, text, label, weight); one task fits it, 0.5 MB come back."""

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            at, data = utf8(b.column("text"))
            ids, labels, n = (b.column(c).to_pylist() for c in ("doc_id", "label", "weight"))
            rows += [(ids[i], data[at[i]:at[i + 1]].tobytes(), labels[i], n[i]) for i in range(len(ids))]
        rows.sort()
        weights, shift = fit([np.frombuffer(r[1], np.uint8) for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([shift])], ["weights", "shift"])

    row = sample.select("doc_id", "text", "label", "weight").repartition(1).mapInArrow(fit_all, "weights binary, shift double").first()
    return (np.frombuffer(bytes(row[0]), np.float32), row[1]) if row else (np.zeros(1 << BITS, np.float32), 0.0)


def scorer(weights: np.ndarray, shift: float) -> Callable[[pa.Array], np.ndarray]:
    def scores(column: pa.Array) -> np.ndarray:
        at, data = utf8(column)
        out = np.empty(len(column))
        for i in range(len(column)):
            slots = gram_slots(data[at[i]:at[i + 1]])
            out[i] = weights[slots].sum(dtype=np.float64) / np.sqrt(max(1, len(slots))) + shift
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    return scores


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`.

    Learns from `labels.quality` of documents whose crc32 rest modulo 5 is not 0; only the text is an input. Null and
    empty texts get the score of a text without n-grams. Repeated rows, null ids and extra columns are fine: each row
    is scored by itself. Empty labels give 0.5 everywhere, an empty table gives an empty result.
    """
    known = labelled_sample(documents, labels, "quality", crc_rest(5) != 0, sample, "quality")
    weights, shift = train(known)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(weights, shift)
        for b in batches:
            s = of(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", (crc_rest(5) == 0).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
