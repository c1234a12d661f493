"""Vectors in cells around pivots, and the bounds on cosines that cells give.

A cell is what lies nearest to one pivot; with the largest angle between the pivot and a member, the cosine of any vector
with all members of the cell is bounded from both sides. Pivots are a sample of at most PIVOTS rows, so all that the driver holds and
tasks get is PIVOTS vectors, sizes and angles. Every row is in exactly one cell. Zero vectors have a cell of their own,
whose cosines are all 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadgrove.functions.hashing import portable_hash
from threadgrove.functions.vectors import unit_rows
from threadgrove.session import stored

PIVOTS = 1024
HELD_BYTES = 64 << 20  # candidate vectors that one task holds
SLACK = 1e-7  # radians that an angle from a rounded cosine may be off


def angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between unit rows and pivots; a zero row is at a right angle to all."""
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0)) if len(pivots) else np.empty((len(u), 0))


def placed(df: DataFrame, pivots: np.ndarray, most: str | None = None) -> DataFrame:
    """`df` with `cell` (the nearest pivot; len(pivots) for a zero vector) and `angle` to it.

    `most` names a column with how many pivots, from the first on, the row may choose from.
    """
    names = [c for c in df.columns if c != most]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit_rows(pa.chunked_array([b.column("embedding")])) if b.num_rows else np.empty((0, 0))
            theta = angles(u, pivots) if b.num_rows else np.empty((0, len(pivots)))
            if most is not None:
                theta = np.where(np.arange(len(pivots)) < np.asarray(b.column(most))[:, None], theta, np.inf)
            zero = ~u.any(axis=1)
            cell = np.where(zero, len(pivots), theta.argmin(axis=1)) if len(pivots) else np.zeros(b.num_rows, int)
            near = np.where(zero, 0.0, theta.min(axis=1)) if len(pivots) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(cell.astype(np.int32)), pa.array(near)],
                                             [*names, "cell", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != most)
    return df.mapInArrow(place, f"{fields}, cell int, angle double")


def sample_pivots(df: DataFrame, key: str, n: int) -> np.ndarray:
    """n vectors of `df` at most, by a hash of their key; no zero vectors."""
    rows = df.orderBy(portable_hash("pivot", key), key).select("embedding").limit(n).toArrow()
    u = unit_rows(rows["embedding"]) if rows.num_rows else np.empty((0, 0))
    return u[u.any(axis=1)]


@dataclass
class Cells:
    """Rows with their `cell`, and by cell: size, largest angle, first group and number of groups.

    A group is what one task holds: near cells of up to `block` rows together, or a part of a larger cell.
    """

    rows: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def groups(self) -> int:
        return int((self.first + self.parts).max(initial=0))

    def bounds(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest cosine that a row may have with a member, rows x cells; -2 for cells without members."""
        theta = angles(u, self.pivots)
        r = self.radius[:-1] + SLACK
        low, high = np.cos(np.minimum(theta + r, np.pi)), np.cos(np.maximum(theta - r, 0.0))
        low, high = [np.hstack([x, np.zeros((len(u), 1))]) for x in (low, high)]
        return np.where(self.size > 0, low, -2.0), np.where(self.size > 0, high, -2.0)

    def grouped(self, key: str) -> DataFrame:
        """Rows with `_g`, the group that holds them."""
        first, parts = [F.from_json(F.lit(str(x.tolist())), "array<int>") for x in (self.first, self.parts)]
        part = F.pmod(F.xxhash64(key), F.get(parts, F.col("cell"))).cast("int")
        return self.rows.withColumn("_g", F.get(first, F.col("cell")) + part)


def make_cells(df: DataFrame, key: str, block: int | None = None, pivots: int = PIVOTS, groups: int = 1,
               n: int | None = None) -> Cells:
    """Cells of the rows of `df`, whose vectors are in `embedding`: about sqrt(rows) of them, PIVOTS at most.

    Groups hold `block` rows at most (by default HELD_BYTES of vectors), and number `groups` at least if there are that many cells.
    """
    n = df.count() if n is None else n
    chosen = sample_pivots(df, key, min(pivots, int(np.ceil(np.sqrt(n)))))
    rows = stored(placed(df, chosen))
    size, radius = np.zeros(len(chosen) + 1, np.int64), np.zeros(len(chosen) + 1)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["a"]
    block = block or max(1024, HELD_BYTES // (8 * max(1, chosen.shape[1])))
    block = max(1, min(block, -(-n // max(1, groups))))
    # near cells side by side: by the nearest of the first few pivots
    few = max(1, int(np.sqrt(len(chosen))))
    order = np.append(np.lexsort((np.arange(len(chosen)), angles(chosen, chosen[:few]).argmin(axis=1))), len(chosen)) if len(chosen) else np.zeros(1, int)
    first, parts, group, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0, 0
    for c in order:
        if size[c] > block:
            group += held > 0
            first[c], parts[c], held = group, -(-size[c] // block), 0
            group += parts[c]
        else:
            if held + size[c] > block:
                group, held = group + 1, 0
            first[c], held = group, held + size[c]
    return Cells(rows, chosen, size, radius, first, parts)
