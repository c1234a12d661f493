"""How well vectors separate classes, and how well clusters agree with them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.functions.rows import beside
from threadgrove.functions.vectors import dot_expr, mean_vector, unit, unit_rows
from threadgrove.operators.assignment import assignment
from threadgrove.operators.cells import HELD_BYTES, placed, sample_pivots
from threadgrove.operators.skew import lookup
from threadgrove.session import stored

GROUP_ROWS = 100_000  # rows of one group that one task adds up
NORMS_HELD = 10_000  # finished groups that a task holds before it hands them on


def _sum_vector(vec: str) -> Column:
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(F.col(vec))).getField("sum"))


def pair_moments(df: DataFrame, group: str, vec: str = "_u") -> DataFrame:
    """n, and mean and population std of the dot products over all unordered pairs, per group.

    No pair is formed. With S the sum of the vectors and G the sum of their outer products, the dot
    products over ordered pairs sum to |S|^2 and their squares to |G|^2; the diagonal is subtracted.
    Rows meet by group, so a task holds one d x d matrix however many groups there are, and hands on |G| alone. Fewer
    than d rows are multiplied the other way, which gives the same |G|. A group of more than GROUP_ROWS rows is
    cut into parts; only parts hand on matrices, one row per (group, matrix row).
    """
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(vec).alias("v"))
    large = stored(rows.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("bigint").alias("_parts"))
                   .filter("_parts > 1"))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    part = F.pmod(F.xxhash64("v", F.spark_partition_id()), parts)
    dealt = rows.join(large, F.col("g").eqNullSafe(F.col("_g")), "left").select("g", part.alias("p"), (parts == 1).alias("whole"), "v")

    def grams(batches):
        open_key, few, gram, norms = None, [], None, {}

        def add(x):
            nonlocal few, gram
            few.append(x)
            if sum(map(len, few)) >= x.shape[1]:
                x = np.concatenate(few)
                gram, few = x.T @ x + (0 if gram is None else gram), []

        def close():
            """Ends the open group: its |G| is noted, or the matrix of a part is returned."""
            nonlocal few, gram
            x, full, (g, _, whole) = np.concatenate(few) if few else None, gram, open_key
            few, gram = [], None
            if whole and full is None:
                norms[g] = float(np.linalg.norm(x @ x.T))
                return
            full = (0 if full is None else full) + (0 if x is None else x.T @ x)
            if whole:
                norms[g] = float(np.linalg.norm(full))
                return
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([g] * len(full), pa.string()), "i": pa.array(range(len(full)), pa.int32()),
                "row": pa.array(list(full), pa.list_(pa.float64()))})

        def noted():
            yield pa.RecordBatch.from_pydict({
                "g": pa.array(list(norms), pa.string()), "i": pa.array([0] * len(norms), pa.int32()),
                "row": pa.array([[n] for n in norms.values()], pa.list_(pa.float64()))})
            norms.clear()

        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "p", "whole"))))
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if open_key is not None and keys[a] != open_key:
                    yield from close()
                open_key = keys[a]
                add(x[a:b])
            if len(norms) >= NORMS_HELD:
                yield from noted()
        if open_key is not None:
            yield from close()
        yield from noted()

    grouped = dealt.repartition("g", "p").sortWithinPartitions("g", "p")
    summed = grouped.mapInArrow(grams, "g string, i int, row array<double>").groupBy("g", "i").agg(_sum_vector("row").alias("r"))
    own = dot_expr("v", "v")
    basic = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size"), _sum_vector("v").alias("_s"),
                                  F.sum(own).alias("_own"), F.sum(own * own).alias("_own2"))
    # both sides have one row per group (or per group and matrix row): add them up instead of joining
    none = F.lit(None).cast("double")
    parts = basic.select("g", "size", dot_expr("_s", "_s").alias("_ss"), "_own", "_own2", none.alias("_gg")).unionByName(
        summed.select("g", F.lit(None).cast("bigint").alias("size"), none.alias("_ss"), none.alias("_own"),
                      none.alias("_own2"), dot_expr("r", "r").alias("_gg")))
    sums = parts.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("size", "_ss", "_own", "_own2", "_gg")])
    pairs = F.col("size") * (F.col("size") - 1) / 2
    mean = F.try_divide((F.col("_ss") - F.col("_own")) / 2, pairs)
    second = F.try_divide((F.col("_gg") - F.col("_own2")) / 2, pairs)
    return sums.select(
        F.col("g").alias(group), "size", mean.alias("mean"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias("std"))


def pair_means(df: DataFrame, group: str, vec: str = "_u") -> DataFrame:
    """n and mean of the dot products over all unordered pairs, per group; needs the vector sums only."""
    sums = df.filter(F.col(vec).isNotNull()).groupBy(F.col(group).cast("string").alias(group)).agg(
        F.count(F.lit(1)).alias("size"), _sum_vector(vec).alias("_s"), F.sum(dot_expr(vec, vec)).alias("_own"))
    pairs = F.col("size") * (F.col("size") - 1)
    return sums.select(group, "size", F.try_divide(dot_expr("_s", "_s") - F.col("_own"), pairs).alias("mean"))


def intra_class(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Per class with at least two rows: size, mean and std of the cosine over its pairs, in linear time."""
    moments = pair_moments(df.withColumn("_u", unit(vec)), label)
    return moments.filter("size >= 2").select(label, "size", F.col("mean").alias("intra_similarity"),
                                              F.col("std").alias("intra_std"))


CLASS_PIVOTS = 256
NEAR = 1e-9  # what a bound is widened by, far above the rounding
CLASS_TILES = 4  # tiles of a class of that many times SMALL_TILE rows and more
SMALL_TILE = 256
STRIP = 1 << 22  # cosines that a task holds at once
MOST_CELLS = 1 << 15  # of a class, so that a pair of cells is one int


def _class_cells(df: DataFrame, key: str, label: str, vec: str, block: int | None, pivots: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rows by cell of their class, the cells with size and largest angle, and the pivots.

    A class of n rows has about 4 n / block cells, around the first pivots of one list of `pivots` at most.
    """
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.col(vec).alias("embedding"))
    rows = stored(rows)
    chosen = sample_pivots(rows, "_k", min(pivots, MOST_CELLS - 1))
    block = block or max(1024, HELD_BYTES // (8 * max(1, chosen.shape[1])))
    most = F.least(F.lit(max(1, len(chosen))), F.ceil(F.col("_n") * 4 / block)).cast("int").alias("_most")
    sizes = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    near = stored(placed(lookup(rows, sizes.select("_l", most), ["_l"], counts=sizes), chosen, "_most"))
    cells = stored(near.groupBy("_l", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")))
    return near.select("_l", "cell", "_k", "embedding"), cells, chosen


def _cell_pairs(cells: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Pairs of cells of a class, each with itself too, with bounds of the cosines between them and that of their pivots."""
    here, there = [cells.select("_l", *[F.col(c).alias(f"{c}{i}") for c in ("cell", "angle", "n")]) for i in (1, 2)]
    alone = (F.col("cell1") == F.col("cell2")) & (F.col("n1") < 2)
    pairs = here.join(there, "_l").filter((F.col("cell1") <= F.col("cell2")) & ~alone).select("_l", "cell1", "cell2", "angle1", "angle2")
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0)) if len(pivots) else np.zeros((0, 0))

    def bound(batches):
        for b in batches:
            x, y, rx, ry = [np.asarray(b.column(c)) for c in ("cell1", "cell2", "angle1", "angle2")]
            zero = (x >= len(pivots)) | (y >= len(pivots))
            if len(pivots):
                theta, r = between[np.minimum(x, len(pivots) - 1), np.minimum(y, len(pivots) - 1)], rx + ry + 2e-7
                low, mid, high = np.cos(np.minimum(theta + r, np.pi)), np.cos(theta), np.cos(np.maximum(theta - r, 0))
            else:
                low = mid = high = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.where(zero, 0.0, x)) for x in (low, mid, high)]], [*b.schema.names, "low", "mid", "high"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(bound, f"{kinds}, low double, mid double, high double")


def _tiles(rows: DataFrame, cells: DataFrame, pairs: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of all pairs of tiles of a class, `a` and `b`, a <= b.

    The rows of the cells that `pairs` names are dealt over tiles by a hash of their key: CLASS_TILES for a large class, so a row is sent
    CLASS_TILES + 1 times however many pairs of cells there are; more only if a tile would hold over `tile` rows. To the first side
    comes one row for a pair of tiles with the pairs of cells to compare, as cell1 * MOST_CELLS + cell2 (as many numbers as there are pairs of pivots at most).
    """
    named = pairs.select("_l", F.explode(F.array("cell1", "cell2")).alias("cell")).distinct()
    used = stored(cells.join(named, ["_l", "cell"]).select("_l", "cell", F.col("n").alias("_n")))
    wide = F.greatest(F.ceil(F.col("_n") / tile), F.least(F.lit(CLASS_TILES), F.ceil(F.col("_n") / SMALL_TILE))).cast("int")
    classes = used.groupBy("_l").agg(F.sum("_n").alias("_n")).select("_l", wide.alias("tiles"))
    dealt = lookup(rows, used.join(classes, "_l").select("_l", "cell", "tiles"), ["_l", "cell"], counts=used)
    part = dealt.withColumn("t", F.pmod(F.xxhash64("_k"), F.col("tiles")).cast("int"))
    first = part.select("_l", F.col("t").alias("a"), F.explode(F.sequence(F.col("t"), F.col("tiles") - 1)).alias("b"), "cell", "_k", "embedding")
    second = part.select("_l", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("a"), F.col("t").alias("b"), "cell", "_k", "embedding")
    # one list per class, as long as the square of the pivots at most
    wanted = pairs.groupBy("_l").agg(F.collect_list((F.col("cell1") * MOST_CELLS + F.col("cell2")).cast("int")).alias("wanted")).join(classes, "_l")
    plan = wanted.select("_l", "wanted", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("a"))
    plan = plan.select("_l", "a", F.explode(F.sequence(F.col("a"), F.col("tiles") - 1)).alias("b"), "wanted")
    return first.unionByName(plan, allowMissingColumns=True), second


def _extremes(rows: DataFrame, cells: DataFrame, pairs: DataFrame, tile: int) -> DataFrame:
    """_l, lo, hi: smallest and largest cosine over the given pairs of cells, one row a pair of tiles; one task holds two tiles."""
    first, second = _tiles(rows, cells, pairs, tile)
    ids = ["_l", "a", "b"]

    def by_cell(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, ascending, keys and unit vectors."""
        cell, key = np.asarray(t["cell"]), np.asarray(t["_k"])
        order = np.argsort(cell, kind="stable")
        return cell[order], key[order], unit_rows(t["embedding"])[order]

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        lo, hi, kind = np.inf, -np.inf, x.schema.field("_l").type
        plan = x.filter(pc.is_valid(x["wanted"]))
        x = x.filter(pc.is_null(x["wanted"]))
        if x.num_rows and y.num_rows and plan.num_rows:
            y = y.rename_columns([c.removesuffix("2") for c in y.schema.names])
            codes = np.asarray(plan["wanted"][0].values)
            one, two = codes // MOST_CELLS, codes % MOST_CELLS
            wanted = np.zeros((int(max(one.max(), two.max(), pc.max(x["cell"]).as_py(), pc.max(y["cell"]).as_py())) + 1,) * 2, bool)
            wanted[one, two] = wanted[two, one] = True
            (cell, key, u), (cell2, key2, v), same = by_cell(x), by_cell(y), x["a"][0] == x["b"][0]
            starts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            for start, end in zip(starts, starts[1:]):
                other = np.flatnonzero(wanted[cell[start], cell2])
                step = max(1, STRIP // max(1, len(other)))
                for at in range(start, end if len(other) else start, step):
                    mine = slice(at, min(end, at + step))
                    sims = u[mine] @ v[other].T
                    if same:  # a tile with itself: no row with itself
                        sims = sims[key[mine][:, None] != key2[other][None, :]]
                    if sims.size:
                        lo, hi = min(lo, float(sims.min())), max(hi, float(sims.max()))
        n = 1 if lo <= hi else 0
        return pa.table({"_l": x["_l"].slice(0, n) if n else pa.array([], kind), "lo": pa.array([lo] * n, pa.float64()), "hi": pa.array([hi] * n, pa.float64())})

    kind = rows.schema["_l"].dataType.simpleString()
    other = second.select(*[F.col(c).alias(f"{c}2") for c in second.columns])  # two sides of one table need names of their own
    return first.groupBy(*ids).cogroup(other.groupBy(*[f"{c}2" for c in ids])).applyInArrow(compare, f"_l {kind}, lo double, hi double")


def class_range_search(df: DataFrame, key: str = "id", label: str = "label", vec: str = "embedding", block: int | None = None,
                       pivots: int = CLASS_PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, visited, pairs): extremes by pair of tiles, the pairs of cells that were compared, and all pairs.

    Branch and bound in two waves. The first compares, for each class, the pair of cells with the nearest pivots and the one with the farthest. Only pairs whose bounds can beat what was found then are compared in the second.
    """
    rows, cells, chosen = _class_cells(df, key, label, vec, block, pivots)
    tile = max(SMALL_TILE, HELD_BYTES // (32 * max(1, chosen.shape[1])))
    pairs = stored(_cell_pairs(cells, chosen))
    ids = ["cell1", "cell2"]
    top = pairs.groupBy("_l").agg(F.max(F.struct("mid", *ids)).alias("h"), F.min(F.struct("mid", *ids)).alias("l"))
    first = top.select("_l", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ids]) for s in "hl"]))).alias("p")).select("_l", "p.*")
    one = stored(_extremes(rows, cells, first, tile))
    best = one.groupBy("_l").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    may = F.col("_lo").isNull() | (F.col("high") + NEAR >= F.col("_hi")) | (F.col("low") - NEAR <= F.col("_lo"))
    rest = pairs.join(best, "_l", "left").filter(may).join(first, ["_l", *ids], "left_anti")
    second = stored(rest.select("_l", *ids))
    return one.unionByName(_extremes(rows, cells, second, tile)), first.unionByName(second), pairs


def intra_class_range(df: DataFrame, key: str = "id", label: str = "label", vec: str = "embedding",
                      block: int | None = None, pivots: int = CLASS_PIVOTS) -> DataFrame:
    """Smallest and largest cosine inside each class with two rows or more; keys are unique. See `class_range_search`."""
    found, _, _ = class_range_search(df, key, label, vec, block, pivots)
    return found.groupBy(F.col("_l").alias(label)).agg(F.min("lo").alias("intra_min"), F.max("hi").alias("intra_max"))


def _centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    return mean_vector(df, [label], vec).select(F.lit("all").alias("_g"), unit("center").alias("_u"))


def inter_class_centroids(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean and std of the cosine between class centroids (means of the raw vectors)."""
    return pair_moments(_centroids(df, label, vec), "_g").select(
        F.col("size").alias("num_classes"), F.coalesce("mean", F.lit(0.0)).alias("inter_similarity"),
        F.coalesce("std", F.lit(0.0)).alias("inter_std"))


def inter_class_exact(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean over class pairs of the mean cosine between their members.

    The mean cosine of two classes is the dot product of their mean unit vectors, and the sum of those
    over all class pairs follows from the sum of the mean vectors.
    """
    means = mean_vector(df.withColumn("_u", unit(vec)), [label], "_u", out="_m")
    total = means.agg(F.count(F.lit(1)).alias("num_classes"), _sum_vector("_m").alias("_s"),
                      F.sum(dot_expr("_m", "_m")).alias("_own"))
    pairs = F.col("num_classes") * (F.col("num_classes") - 1) / 2
    return total.select("num_classes", F.coalesce(
        F.try_divide((dot_expr("_s", "_s") - F.col("_own")) / 2, pairs), F.lit(0.0)).alias("inter_similarity"))


def class_separation(df: DataFrame, label: str = "label", vec: str = "embedding", centroids: bool = True) -> DataFrame:
    """One row: mean intra-class and inter-class similarity and their difference. No deviation is computed."""
    intra = pair_means(df.withColumn("_u", unit(vec)), label).filter("size >= 2").agg(
        F.coalesce(F.avg("mean"), F.lit(0.0)).alias("intra_class_similarity"))
    inter = inter_class_exact(df, label, vec) if not centroids else pair_means(_centroids(df, label, vec), "_g").select(
        F.col("size").alias("num_classes"), F.coalesce("mean", F.lit(0.0)).alias("inter_similarity"))
    return beside(intra, inter).select(
        "intra_class_similarity", F.col("inter_similarity").alias("inter_class_similarity"),
        (F.col("intra_class_similarity") - F.col("inter_similarity")).alias("margin"), "num_classes")


# ---- clusters -------------------------------------------------------------------------------------

def _nearest(u: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equal ones, and the squared distance to it."""
    apart = (centers * centers).sum(axis=1) - 2 * (u @ centers.T)
    near = apart.argmin(axis=1)
    return near, np.maximum(apart[np.arange(len(u)), near] + (u * u).sum(axis=1), 0.0)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name).flatten(), np.float64).reshape(b.num_rows, -1)


BLOCK_ROWS = 4096  # rows of a matrix block


def _blocks(rows: DataFrame) -> RDD:
    """The vectors `_x` as matrices of at most BLOCK_ROWS rows, kept by the executors (on disk, what does not fit)."""

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "data": [_matrix(part, "_x").tobytes()]})

    packed = rows.select("_x").mapInArrow(pack, "n bigint, data binary")
    return packed.rdd.map(lambda r: np.frombuffer(bytes(r["data"])).reshape(r["n"], -1)).persist(StorageLevel.MEMORY_AND_DISK)


def _lloyd_step(blocks: RDD, centers: dict[int, np.ndarray]) -> dict:
    """run -> number, squared distances and sums of the rows nearest to each of its centres."""

    def add(part):
        held = {}
        for u in part:
            for run, c in centers.items():
                near, cost = _nearest(u, c)
                member = (near[:, None] == np.arange(len(c))).astype(float)
                new = member.sum(axis=0), cost @ member, member.T @ u
                held[run] = tuple(x + y for x, y in zip(held[run], new)) if run in held else new
        yield held

    def merge(a, b):
        return {run: tuple(x + y for x, y in zip(a[run], b[run])) if run in a and run in b else a.get(run, b.get(run)) for run in {**a, **b}}

    return blocks.mapPartitions(add).treeReduce(merge)


def _lloyd(blocks: RDD, centers: dict[int, np.ndarray], max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Centres and inertia of the best run. All runs that still move share one pass over the rows an iteration."""
    open_, done = dict(centers), {}
    for i in range(max_iter):
        found, cost = {}, {}
        for run, (n, spent, total) in _lloyd_step(blocks, open_).items():
            found[run] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], open_[run])  # a centre without rows stays
            cost[run] = float(spent.sum())
        for run in list(open_):
            if i == max_iter - 1 or (((found[run] - open_[run]) ** 2).sum(axis=1) <= tol * tol).all():
                done[run] = found[run], cost[run]
                found.pop(run)
        open_ = found
        if not open_:
            break
    return min((done[run] for run in sorted(done)), key=lambda x: x[1])


def kmeans_labels(df: DataFrame, k: int | None = None, n_init: int = 10, max_iter: int = 300, seed: int = 42,
                  label: str = "label", vec: str = "embedding", normalize: bool = True) -> tuple[DataFrame, float]:
    """(rows with `cluster`, inertia) of the best of `n_init` k-means runs; k defaults to the number of labels.

    The first centres of a run are those of `pyspark.ml` (k-means||) for its seed. The runs then move together: an iteration
    is one job for all of them, so their number costs no further passes.
    """
    x = unit(vec) if normalize else F.col(vec).cast("array<double>")
    rows = stored(df.withColumn("_x", x))
    if k is None:
        k = rows.select(F.count_distinct(label).alias("k")).first()["k"]
    points = rows.select(array_to_vector("_x").alias("features")).persist()
    starts = {i: np.array(KMeans(k=k, maxIter=0, seed=seed + i, tol=1e-4).fit(points).clusterCenters()) for i in range(n_init)}
    points.unpersist()
    blocks = _blocks(rows)
    centers, inertia = _lloyd(blocks, starts, max_iter, 1e-4)
    blocks.unpersist()

    def label_rows(batches):
        for b in batches:
            near = _nearest(_matrix(b, "_x"), centers)[0] if b.num_rows else np.zeros(0, np.int64)
            kept = b.drop_columns(["_x"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.astype(np.int64))], [*kept.schema.names, "cluster"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(label_rows, f"{kinds}, cluster bigint"), float(inertia)


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster", by: tuple[str, ...] = ()) -> DataFrame:
    """Row counts per (label, cluster); everything below works on this small table."""
    return df.groupBy(*by, F.col(label).cast("string").alias("label"), F.col(cluster).cast("string").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"))


def _keyed(by: tuple[str, ...]) -> list[str]:
    return list(by) or ["_one"]


def _with_key(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return table if by else table.withColumn("_one", F.lit(1))


def _margin_sums(table: DataFrame, by: tuple[str, ...], f) -> DataFrame:
    """Per key: total rows, and the sum of f(count) over the cells, the labels and the clusters.

    Every cell is counted once as itself, once for its label and once for its cluster, so the margins
    need no join.
    """
    kinds = F.explode(F.array(F.struct(F.lit("cell").alias("kind"), F.col("label").alias("a"), F.col("cluster").alias("b")),
                              F.struct(F.lit("label").alias("kind"), F.col("label").alias("a"), F.lit("").alias("b")),
                              F.struct(F.lit("cluster").alias("kind"), F.lit("").alias("a"), F.col("cluster").alias("b"))))
    rows = table.select(*by, "n", kinds.alias("_k")).groupBy(*by, "_k").agg(F.sum("n").cast("double").alias("n"))
    kind = F.col("_k.kind")
    return rows.groupBy(*by).agg(
        F.sum(F.when(kind == "cell", F.col("n"))).alias("total"),
        *[F.sum(F.when(kind == k, f(F.col("n")))).alias(k) for k in ("cell", "label", "cluster")])


def nmi(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Normalised mutual information, normalised by the arithmetic mean of both entropies.

    With S(x) the sum of x log x: H = log N - S / N, and the mutual information is
    log N + (S(cells) - S(labels) - S(clusters)) / N.
    """
    s, n = _margin_sums(table, by, lambda x: x * F.log(x)), F.col("total")
    shared = F.log(n) + (F.col("cell") - F.col("label") - F.col("cluster")) / n
    mean = F.log(n) - (F.col("label") + F.col("cluster")) / n / 2
    # one class and one cluster agree fully
    return s.select(*by, F.when(mean <= 1e-15, F.lit(1.0)).otherwise(F.greatest(shared, F.lit(0.0)) / mean).alias("nmi"))


def ari(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted Rand index from pair counts."""
    def pairs(x):
        return x * (x - 1) / 2

    s = _margin_sums(table, by, pairs)
    expected = F.col("label") * F.col("cluster") / pairs(F.col("total"))
    top = (F.col("label") + F.col("cluster")) / 2
    return s.select(*by, F.when(top == expected, F.lit(1.0)).otherwise((F.col("cell") - expected) / (top - expected)).alias("ari"))


def purity(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows that carry the most frequent label of their cluster."""
    keys, t = _keyed(by), _with_key(table, by)
    best = t.groupBy(*keys, "cluster").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.groupBy(*keys).agg((F.sum("m") / F.sum("t")).alias("purity")).select(*by, "purity")


DENSE_CELLS = 1 << 22  # 32 MB of counts: tables up to this are solved in one task each, larger ones by an auction


def _best_assignment(gain: np.ndarray) -> float:
    """Largest total of a one-to-one choice of rows and columns (shortest augmenting paths)."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    n, m = gain.shape
    cost = gain.max() - gain
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, reached, col = start, 0.0, -1
        while True:
            step = reached + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reached = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        visited = done & (owner >= 0)
        row_price[owner[visited]] += reached - dist[visited]
        row_price[start] += reached
        col_price[done] -= reached - dist[done]
        while col >= 0:
            before = via[col]
            owner[col] = start if before < 0 else owner[before]
            col = before
    return float(sum(gain[r, c] for c, r in enumerate(owner) if r >= 0))


def cluster_accuracy(table: DataFrame, by: tuple[str, ...] = (), dense: int = DENSE_CELLS) -> DataFrame:
    """Share of rows on the best one-to-one assignment of clusters to labels, exact for any table.

    One key is one contingency table. Tables of up to `dense` labels x clusters are solved in one task each; the cells of
    larger ones go to an auction (`operators.assignment`), all keys together.
    """
    keys = _keyed(by)
    t = stored(_with_key(table, by).filter("n > 0"))
    types = dict(t.dtypes)
    sizes = stored(t.groupBy(*keys).agg((F.count_distinct("label") * F.count_distinct("cluster")).alias("_cells"), F.sum("n").alias("_all")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="label", columns="cluster", values="n", aggfunc="sum", fill_value=0).to_numpy(float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "best": [_best_assignment(m)]})

    def cells(large: bool) -> DataFrame:
        wanted = F.col("_cells") > dense
        return t.join(sizes.filter(wanted if large else ~wanted).select(*keys), keys)

    best = cells(False).groupBy(*keys).applyInPandas(solve, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", best double")
    if not sizes.filter(F.col("_cells") > dense).isEmpty():
        named = cells(True).select(*[F.struct(*keys, F.col(c).alias("name")).alias(side) for c, side in (("label", "row"), ("cluster", "column"))], "n")
        chosen = assignment(named).groupBy(*[F.col(f"row.{k}").alias(k) for k in keys]).agg(F.sum("n").cast("double").alias("best"))
        best = best.unionByName(chosen)
    return best.join(sizes, keys).select(*by, (F.col("best") / F.col("_all")).alias("accuracy"))
