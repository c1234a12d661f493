"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into tiles, a tile is cut into lists of at most LIST rows, sorted once per dimension. A query reads
all its dimensions' lists in step from its favourable end, scores every row it meets whole, and stops a list as soon as
the bound, the sum of the values last read, cannot beat its k-th best score so far. Queries meet the tiles in blocks;
per query and tile at most k rows come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.session import stored

K = 10
SCALE = 1024
LIST = 4096
TILE_ROWS = 1 << 17
QUERY_ROWS = 1 << 14
FIRST_DEPTH = 64


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of a vector; null if it or a component is null or not finite."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, wide.cast("array<bigint>"))


class Lists:
    """Rows of one list with their ids ascending, and per dimension the rows from the largest value to the smallest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query: np.ndarray, own: int, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (-score, id) of `best` and this list, without the id `own`."""
        n, used = len(self.ids), np.flatnonzero(query)
        down = query[used] > 0
        seen = np.zeros(n, bool)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            until = min(n, depth + step)
            rows = np.arange(depth, until)
            met = np.zeros(n, bool)
            if down.any():
                met[self.order[rows[:, None], used[down]]] = True
            if not down.all():
                met[self.order[n - 1 - rows[:, None], used[~down]]] = True
            if not len(used):
                met[:] = True
                until = n
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            scores = self.vectors[new] @ query
            if len(best) == k:
                good = scores >= -best[-1][0]
                new, scores = new[good], scores[good]
            if len(new):
                top = np.lexsort((self.ids[new], -scores))[:k]
                best = sorted(best + [(-int(scores[i]), int(self.ids[new[i]])) for i in top])[:k]
            depth, step = until, step * 2
            last = np.where(down, self.sorted[depth - 1, used], self.sorted[n - depth, used])
            # a row not met yet scores at most the bound; at equality it could still win by its smaller id
            if len(best) == k and last @ query[used] < -best[-1][0]:
                break
        return best


def top_k(vectors: DataFrame, query: Column, k: int = K, scale: int = SCALE, id_column: str = "vec_id",
          vector_column: str = "embedding", tile_rows: int = TILE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every id with a row that satisfies `query`, its k best rows of other ids.

    Components become floor(scale * x); the score is their inner product in whole numbers; ties go to the smaller id. Rows
    whose id or vector is null, or whose vector holds a null, NaN or infinity, take no part; shorter vectors count as filled up
    with zeros. Rows that repeat an id are candidates each, equal ones too; the lists of several query rows of one id are
    merged, so a candidate comes once for every such row. With fewer than k others all come out;
    an empty table gives an empty result. Further columns are not read. Components whose scores could reach 2^53 are an
    error: they would not be exact. Equal rows are counted before they are dealt (more than k of them add nothing), so a
    vector with a third of the rows is one row of one tile.
    """
    usable = vectors.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), whole_numbers(F.col(vector_column), scale).alias("v"),
                                                                 query.alias("asks"))
    asks = F.coalesce(F.col("asks"), F.lit(False))
    rows = stored(usable.filter(F.col("v").isNotNull()).groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"),
                                                                               F.least(F.count_if(asks), F.lit(k)).cast("int").alias("asked")))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("asked") > 0).alias("q"), F.max(F.size("v")).alias("d"), F.max(most).alias("most")).first()
    if (facts["d"] or 0) * (facts["most"] or 0.0) ** 2 >= 2.0 ** 53:
        raise ValueError(f"components up to {facts['most']:g} in {facts['d']} dimensions: scores may exceed 2^53")
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles, blocks, width = max(least, -(-facts["n"] // tile_rows)), max(1, -(-facts["q"] // query_rows)), facts["d"] or 1

    dealt = lambda number, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("v")), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    candidates = rows.select(dealt(tiles, 1).alias("tile"), every(blocks).alias("block"), "id", "v", "n")
    asked = rows.filter("asked > 0").select(every(tiles).alias("tile"), dealt(blocks, 2).alias("block"), "id", "v", F.col("asked").alias("n"))

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, lists = table.column("id").to_numpy(), table.column("v").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        if len(flat) == len(ids) * width:
            out = flat.reshape(len(ids), width).astype(float)
        else:
            out = np.zeros((len(ids), width))
            for i in range(len(ids)):
                out[i, :ends[i + 1] - ends[i]] = flat[ends[i]:ends[i + 1]]
        order = np.argsort(ids, kind="stable")
        return np.repeat(ids[order], table.column("n").to_numpy()[order]), np.repeat(out[order], table.column("n").to_numpy()[order], axis=0)

    def search(asking: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if asking.num_rows and held.num_rows:
            ids, values = matrix(held)
            lists = [Lists(ids[a:a + LIST], values[a:a + LIST]) for a in range(0, len(ids), LIST)]
            for own, q in zip(*matrix(asking)):
                best: list[tuple[int, int]] = []
                for part in lists:
                    best = part.search(q, int(own), best, k)
                out += [(int(own), i, -s) for s, i in best]
        q, i, s = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    found = asked.groupBy("tile", "block").cogroup(candidates.groupBy("tile", "block")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
