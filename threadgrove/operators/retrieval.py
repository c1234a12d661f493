"""Exact ranked retrieval: bounds decide which candidates a query has to meet.

Candidates lie in cells around pivots (`operators.cells`). A first wave sends each query to the cells with the best bounds
that hold k candidates; its k-th best cosine then rules out every cell whose bound is below, and the second wave sends the query to
the rest. So the result is exact, and vectors in clusters meet few cells. A task holds a part of the queries, sized by memory, with the
best candidates they have met, and the candidates stream past in blocks. A query is sent once and hands on k rows, however many cells it
meets; candidates are copied once for each part of the queries. Few queries meet many candidates in several lanes, each with a share
of the groups. Labels play no part in the cutting, so a label with a third of the rows is no hot spot, and a crowded cell is cut into parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadgrove.functions.rows import beside
from threadgrove.functions.vectors import unit_rows
from threadgrove.operators.cells import HELD_BYTES, PIVOTS, Cells, make_cells
from threadgrove.operators.ranking import best_per_group
from threadgrove.operators.skew import lookup
from threadgrove.session import stored

DIGITS = 12  # similarities are compared after rounding, so that equal vectors tie everywhere
NEAR = 1e-9  # what a bound is widened by, far above the rounding
HALF = 0.5 * 10.0 ** -DIGITS  # half a step of the rounding
BATCH = 1024  # queries whose cells are chosen together
DEALT_ROWS = 8192  # dealt rows that are handed on together
STRIP = 1 << 18  # cosines that a task computes at once
HELD_SHARE = 4  # the queries that a task holds take this part of HELD_BYTES, besides what they have found
FOUND_ROWS = 1 << 16  # found rows that are handed on together
ROUNDS = 2  # parts of the queries for each task that runs at once
CHOOSING = ("_in", "_floor", "_seen")  # columns that only the choice of cells needs

Choose = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]


def _units(b) -> np.ndarray:
    return unit_rows(pa.chunked_array([b.column("embedding")]) if isinstance(b, pa.RecordBatch) else b["embedding"])


def first_cells(cells: Cells, high: np.ndarray, k: int) -> np.ndarray:
    """Per row the cells with the best bounds that together hold k candidates (all, if there are fewer)."""
    order = np.argsort(-high, axis=1, kind="stable")
    sizes = cells.size[order]
    needed = (np.cumsum(sizes, axis=1) - sizes < k) & (sizes > 0)
    out = np.zeros(high.shape, bool)
    np.put_along_axis(out, order, needed, axis=1)
    return out


@dataclass
class Grid:
    """How queries and candidates are cut: a task for each part of the queries and lane of the groups."""

    parts: int
    lanes: int


def _grid(tasks: int, n: int, m: int, cells: Cells) -> Grid:
    """What is copied is least if both sides are cut in proportion to their sizes; a part of the queries fits in memory."""
    lanes = int(np.clip(np.sqrt(tasks * m / max(1, n)), 1, max(1, min(tasks, cells.groups))))
    held = max(1024, HELD_BYTES // (HELD_SHARE * 8 * max(1, cells.pivots.shape[1] if cells.pivots.ndim > 1 else 1)))
    return Grid(max(-(-ROUNDS * tasks // lanes), -(-n // held), 1), lanes)


def _lane(group, cells: Cells, lanes: int):
    return group * lanes // max(1, cells.groups)


def deal(queries: DataFrame, cells: Cells, lanes: int, choose: Choose, whole: bool = False) -> DataFrame:
    """One row per query and lane that has a cell for it: the query's columns but those of CHOOSING, `_l`, `_cells` (those chosen, a bit
    each), `_met` (their number in the lane; a cell in parts counts by its groups).

    `choose(low, high, batch)` gives rows x cells. With `whole`, `_whole` counts the candidates of the cells whose lower bound is above the
    query's `_sim`, on the first of its rows; such cells are not visited.
    """
    size = cells.size
    names = [c for c in queries.columns if c not in CHOOSING]
    # groups of each cell by lane
    held = np.zeros((len(size), lanes), np.int64)
    for c in np.flatnonzero(size > 0):
        np.add.at(held[c], _lane(cells.first[c] + np.arange(cells.parts[c]), cells, lanes), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                b = big.slice(at, BATCH)
                low, high = cells_.bounds(_units(b))
                needed = choose(low, high, b)
                above = np.zeros(b.num_rows, np.int64)
                if whole:
                    sure = (low - NEAR > np.asarray(b.column("_sim"))[:, None]) & (size > 0)
                    above, needed = sure @ size, needed & ~sure
                needed = needed & (size > 0)
                bits, met = np.packbits(needed, axis=1), needed @ held
                row, lane = np.nonzero(met)
                lead = np.concatenate([[True], np.diff(row) != 0])[:len(row)]
                kept = b.select(names)
                for x in range(0, len(row), DEALT_ROWS):
                    i, n = row[x:x + DEALT_ROWS], lane[x:x + DEALT_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [*kept.take(pa.array(i)).columns, pa.array(n.astype(np.int32)), pa.array([z.tobytes() for z in bits[i]], pa.binary()),
                         pa.array(met[i, n]), pa.array(np.where(lead[x:x + DEALT_ROWS], above[i], 0))],
                        [*names, "_l", "_cells", "_met", "_whole"])

    cells_ = Cells(None, cells.pivots, size, cells.radius, cells.first, cells.parts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema if f.name in names)
    return queries.mapInArrow(run, f"{fields}, _l int, _cells binary, _met bigint, _whole bigint")


@dataclass
class Piece:
    """Candidates of one cell, by label and then in the order of their ids; `of` is the number of the label, -2 for one that no query has."""

    unit: np.ndarray
    ids: np.ndarray
    of: np.ndarray

    def labels(self) -> Iterator[tuple[int, slice]]:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(self.of)) + 1, [len(self.of)]])
        return ((int(self.of[a]), slice(a, b)) for a, b in zip(edges, edges[1:]) if self.of[a] >= 0)


@dataclass
class Held:
    """The queries of a task, by label; `label` is its number, -1 for a missing one, which equals none."""

    rows: pa.Table
    unit: np.ndarray
    label: np.ndarray


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("ids of candidates must not be null")
    return np.array(column.to_pylist(), object) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else np.asarray(column)


def _order(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


def strips(rows: np.ndarray, held: Held, piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the rows at a time, with their cosines."""
    step = max(16, STRIP // max(1, len(piece.ids)))
    for at in range(0, len(rows), step):
        i = rows[at:at + step]
        mine = held.unit[i[0]:i[-1] + 1] if i[-1] - i[0] + 1 == len(i) else held.unit[i]
        yield i, mine @ piece.unit.T


def meet(dealt: DataFrame, cells: Cells, grid: Grid, schema: str, start: Callable, visit: Callable, finish: Callable) -> DataFrame:
    """Bring dealt queries and the candidates of their lanes together.

    A task holds its queries, `state = start(held)`, and gets the candidates of its lane in pieces of one cell: `visit(state, rows, piece)` with the
    rows that chose the cell. At the end come the batches of `finish(state)`.
    """
    parts, lanes, n_cells = grid.parts, grid.lanes, len(cells.size)
    lane = F.floor(F.col("_g") * lanes / max(1, cells.groups))
    right = cells.grouped("candidate_id").select("_g", "candidate_id", "cell", "label", "embedding", F.lit(False).alias("_q"),
                                                 F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"), lane.alias("_l"))
    right = right.withColumn("_t", (F.col("_l") * parts + F.col("_p")).cast("int")).drop("_l", "_p")
    left = dealt.withColumn("_q", F.lit(True)).withColumn("_t", (F.col("_l") * parts + F.pmod(F.xxhash64("query_id"), F.lit(parts))).cast("int")).drop("_l", "_met")
    both = left.unionByName(right, allowMissingColumns=True)
    sorted_ = both.repartitionById(parts * lanes, F.col("_t")).sortWithinPartitions(F.desc("_q"), "_g", "cell", "candidate_id")

    def hold(t: pa.Table) -> tuple[Held, np.ndarray, pa.Array]:
        names = pc.unique(t["label"].combine_chunks()).drop_null()
        label = np.asarray(pc.fill_null(pc.index_in(t["label"], names), -1).combine_chunks())
        order = np.argsort(label, kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        chosen = np.frombuffer(b"".join(t["_cells"].to_pylist()), np.uint8).reshape(len(t), -1)
        unit = _units(t)
        t = t.drop_columns(["embedding", "_cells"])
        return Held(t, unit, label[order]), np.ascontiguousarray(np.unpackbits(chosen, axis=1, count=n_cells).T).view(bool), names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held = [], None
        for batch in batches:
            n = int(pc.sum(batch.column("_q")).as_py() or 0)  # queries come first
            if n:
                queries.append(batch.slice(0, n).select(wanted))
            if n == batch.num_rows or not queries and held is None:
                continue
            if held is None:
                (held, chosen, names), queries = hold(pa.Table.from_batches(queries)), []
                state = start(held)
            batch = batch.slice(n)
            cell = np.stack([np.asarray(batch.column(c)) for c in ("_g", "cell")])
            edges = [0, *(np.flatnonzero((np.diff(cell, axis=1) != 0).any(axis=0)) + 1), batch.num_rows]
            of = np.asarray(pc.fill_null(pc.index_in(batch.column("label"), names), -2))
            unit, ids = _units(batch), _ids(batch.column("candidate_id"))
            for a, b in zip(edges, edges[1:]):
                rows = np.flatnonzero(chosen[cell[1, a]])
                if len(rows):
                    at = a + np.argsort(of[a:b], kind="stable")
                    visit(state, rows, Piece(unit[at], ids[at], of[at]))
        if held is None and queries:
            state = start(hold(pa.Table.from_batches(queries))[0])
        elif held is None:
            return
        yield from finish(state)

    wanted = [c for c in left.columns if c not in ("_q", "_t")]
    return sorted_.mapInArrow(run, schema)


def _best(sims: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest similarities of each row, smaller ranks first among equal ones."""
    low = np.partition(sims, -n, axis=1)[:, -n]
    rows, cols = np.nonzero(sims >= low[:, None])
    order = np.lexsort((rank[rows, cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(sims)))[rows] < n
    return cols[keep].reshape(len(sims), n)


class _Top:
    """The k best candidates of each row so far. What may be among them is noted, and sorted in when there is much of it."""

    def __init__(self, n: int, k: int, bar: np.ndarray, kind):
        self.k, self.bar = k, bar  # bar: rounded cosines below it are out
        self.sims, self.same = np.full((n, k), -np.inf), np.zeros((n, k), bool)
        self.ids = np.full((n, k), "" if kind == object else 0, kind)
        self.last = np.full(n, "" if kind == object else 0, kind)  # the id of the k-th, where `full`
        self.full = np.zeros(n, bool)
        self.noted, self.size = [], 0

    def add(self, rows: np.ndarray, sims: np.ndarray, piece: Piece, label: np.ndarray) -> None:
        k, bar, lowest = self.k, self.bar[rows], piece.ids.min()
        empty = ~self.full[rows]
        if sims.shape[1] > k and empty.any():
            # nothing to compare with yet: the best of this piece
            at = np.flatnonzero(empty & (bar == -np.inf))
            if len(at):
                mine = np.round(sims[at], DIGITS)
                col = _best(mine, np.broadcast_to(_order(piece.ids), mine.shape), k)
                self._note(np.repeat(rows[at], k), np.take_along_axis(mine, col, 1).ravel(), col.ravel(), piece, np.repeat(label[at], k))
                self.sort()
                bar = bar.copy()
                bar[at] = np.inf  # done
        # an equal cosine counts only with a smaller id than that of the k-th
        strict = self.full[rows] & (self.last[rows] < lowest)
        hit = sims > (bar + np.where(strict, 0.8, -1.2) * HALF)[:, None]
        spot = np.flatnonzero(hit)
        if len(spot):
            row, col = np.divmod(spot, sims.shape[1])
            found = np.round(sims.ravel()[spot], DIGITS)
            good = found >= bar[row]
            self._note(rows[row[good]], found[good], col[good], piece, label[row[good]])
            if self.size > max(4096, self.sims.size // 2):
                self.sort()

    def _note(self, row, sims, col, piece, label) -> None:
        self.noted.append((row, sims, piece.ids[col], label == piece.of[col]))
        self.size += len(row)

    def sort(self) -> None:
        if not self.size:
            return
        row, sims, ids, same = [np.concatenate(x) for x in zip(*self.noted)]
        self.noted, self.size, k = [], 0, self.k
        new = np.unique(row)
        held = self.sims[new] > -np.inf
        row = np.concatenate([np.repeat(new, held.sum(axis=1)), row])
        sims, ids, same = [np.concatenate([x[new][held], y]) for x, y in ((self.sims, sims), (self.ids, ids), (self.same, same))]
        order = np.lexsort((_order(ids), -sims, row))
        row = row[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        keep = place < k
        order, row, place = order[keep], row[keep], place[keep]
        self.sims[new] = -np.inf
        self.sims[row, place], self.ids[row, place], self.same[row, place] = sims[order], ids[order], same[order]
        whole = new[self.sims[new, k - 1] > -np.inf]
        self.full[whole], self.last[whole] = True, self.ids[whole, k - 1]
        self.bar[whole] = np.maximum(self.bar[whole], self.sims[whole, k - 1])

    def hits(self) -> tuple[np.ndarray, ...]:
        self.sort()
        row, col = np.nonzero(self.sims > -np.inf)
        return row, self.ids[row, col], self.sims[row, col], self.same[row, col]


class _Match:
    """The best candidate of the same label of each row."""

    def __init__(self, n: int, kind):
        self.sims, self.ids = np.full(n, -np.inf), np.full(n, "" if kind == object else 0, kind)

    def add(self, rows: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        """`ids` ascend."""
        at = np.flatnonzero(sims.max(axis=1) > self.sims[rows] - 1.2 * HALF)
        if len(at):
            mine, rows = np.round(sims[at], DIGITS), rows[at]
            col = mine.argmax(axis=1)
            best, id_ = mine[np.arange(len(at)), col], ids[col]
            new = (best > self.sims[rows]) | (best == self.sims[rows]) & (id_ < self.ids[rows])
            self.sims[rows[new]], self.ids[rows[new]] = best[new], id_[new]

    def hits(self) -> tuple[np.ndarray, ...]:
        row = np.flatnonzero(self.sims > -np.inf)
        return row, self.ids[row], self.sims[row], np.ones(len(row), bool)


def _search(dealt: DataFrame, cells: Cells, grid: Grid, k: int, kinds: tuple[str, ...] = ("top", "match")) -> DataFrame:
    """Per query and lane: the k best candidates ('top') and the best one of the same label ('match'). Cosines below `_bar`, where given, are left out of the k best."""
    types = {"query_id": dealt.schema["query_id"].dataType, "candidate_id": cells.rows.schema["candidate_id"].dataType}
    schema = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items()) + ", similarity double, same boolean, kind string"
    arrow = to_arrow_type(types["candidate_id"])
    kind = object if pa.types.is_string(arrow) or pa.types.is_large_string(arrow) else np.int64

    def start(held: Held) -> dict:
        n = len(held.unit)
        bar = np.asarray(pc.fill_null(held.rows["_bar"], -np.inf)).copy() if "_bar" in held.rows.column_names else np.full(n, -np.inf)
        made = {"top": lambda: _Top(n, k, bar, kind), "match": lambda: _Match(n, kind)}
        return {"held": held} | {x: made[x]() for x in kinds}

    def visit(state: dict, rows: np.ndarray, piece: Piece) -> None:
        held = state["held"]
        label = held.label[rows]
        if "top" not in kinds:
            # only rows and candidates of one label meet
            for of, at in piece.labels():
                own = rows[np.searchsorted(label, of):np.searchsorted(label, of, "right")]
                for i, sims in strips(own, held, Piece(piece.unit[at], piece.ids[at], piece.of[at])):
                    state["match"].add(i, sims, piece.ids[at])
            return
        for i, sims in strips(rows, held, piece):
            label = held.label[i]
            if "match" in kinds:
                for of, at in piece.labels():
                    a, b = np.searchsorted(label, of), np.searchsorted(label, of, "right")
                    if a < b:
                        state["match"].add(i[a:b], sims[a:b, at], piece.ids[at])
            state["top"].add(i, sims, piece, label)

    def finish(state: dict) -> Iterator[pa.RecordBatch]:
        for x in kinds:
            row, ids, sims, same = state[x].hits()
            for a in range(0, len(row), FOUND_ROWS):
                at = slice(a, a + FOUND_ROWS)
                n = len(row[at])
                yield pa.RecordBatch.from_arrays(
                    [state["held"].rows["query_id"].combine_chunks().take(pa.array(row[at])), pa.array(ids[at], arrow), pa.array(sims[at]),
                     pa.array(same[at]), pa.array([x] * n, pa.string())], ["query_id", "candidate_id", "similarity", "same", "kind"])

    return meet(dealt, cells, grid, schema, start, visit, finish)


def _merge(hits: DataFrame, kind: str, k: int) -> DataFrame:
    rows = hits.filter(F.col("kind") == kind).drop("kind")
    return best_per_group(rows, ["query_id"], [F.desc("similarity"), F.asc("candidate_id")], k, "rank")


@dataclass
class Search:
    """Both waves: their hits, and what they cost. Queries and candidates as from `_sides`."""

    queries: DataFrame
    n_queries: int
    cells: Cells
    grid: Grid
    hits: DataFrame
    waves: tuple[DataFrame, DataFrame]

    def visits(self) -> tuple[int, int]:
        """Pairs of a query and a cell that met, and how many there are in all."""
        met = sum(w.agg(F.coalesce(F.sum("_met"), F.lit(0))).first()[0] for w in self.waves)
        whole = self.n_queries * int(np.where(self.cells.size > 0, self.cells.parts, 0).sum())
        return met, whole


def search(queries: DataFrame, candidates: DataFrame, k: int, block: int | None = None, pivots: int = PIVOTS, match: bool = True) -> Search:
    """The hits of both waves; `block` is how many candidates the queries of a task meet at a time. With `match` also the best ones of the same label."""
    counted = Observation(), Observation()
    queries, candidates = [stored(d, o, n=F.count(F.lit(1))) for d, o in zip((queries, candidates), counted)]
    tasks, n, m = queries.sparkSession.sparkContext.defaultParallelism, *[o.get["n"] for o in counted]
    groups = int(np.clip(np.sqrt(tasks * m / max(1, n)), 1, tasks))
    cells = make_cells(candidates, "candidate_id", block, pivots, groups, m)
    grid = _grid(tasks, n, m, cells)
    kinds = ("top", "match") if match else ("top",)

    def first(low, high, b):
        return first_cells(cells_, high, k)

    def second(low, high, b):
        floor = np.nan_to_num(np.asarray(b.column("_bar")).astype(float), nan=-np.inf)
        return (high + NEAR >= floor[:, None]) & ~first_cells(cells_, high, k)

    cells_ = Cells(None, cells.pivots, cells.size, cells.radius, cells.first, cells.parts)
    near = deal(queries, cells, grid.lanes, first)
    one = stored(_search(near, cells, grid, k, kinds))
    floors = _merge(one, "top", k).filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("_bar"))
    far = deal(queries.join(floors, "query_id", "left"), cells, grid.lanes, second)
    two = stored(_search(far, cells, grid, k, kinds))
    return Search(queries, n, cells, grid, one.unionByName(two), (near, far))


def _sides(queries: DataFrame, candidates: DataFrame, id_col: str, label: str, vec: str):
    def side(df, name):
        key = F.col(id_col) if dict(df.dtypes)[id_col] == "string" else F.col(id_col).cast("bigint")
        return df.filter(F.col(vec).isNotNull()).select(
            key.alias(name), F.col(label).cast("string").alias("label"), F.col(vec).alias("embedding"))

    return side(queries, "query_id"), side(candidates, "candidate_id")


def rank_candidates(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "id", label: str = "label",
                    vec: str = "embedding", block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """The k most similar candidates of every query, best first; ties go to the smaller candidate id.

    Ids are numbers or strings, unique on either side. `block` is how many candidates the queries of a task meet at a time, by default as many as fit in 64 MB.
    """
    return _merge(search(*_sides(queries, candidates, id_col, label, vec), k, block, pivots, match=False).hits, "top", k)


def precision_at_k(ranked: DataFrame, queries: int | Column, ks: tuple[int, ...] = (1, 3, 5, 10),
                   candidates: int | Column | None = None) -> DataFrame:
    """Mean precision per k over all queries; k is clipped to the number of candidates. `ranked` has max(ks) ranks."""
    # a query's last rank is the number of candidates where these are fewer than the ranks asked for
    size = ranked.select(F.max("rank").alias("n")).scalar() if candidates is None else (candidates if isinstance(candidates, Column) else F.lit(candidates))
    each = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    rows = ranked.select("same", "rank", each).filter((F.col("rank") <= F.col("k")) & F.col("same"))
    total = queries if isinstance(queries, Column) else F.lit(queries)
    hits = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_hits"))
    wanted = ranked.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return wanted.join(hits, "k", "left").select(
        F.col("k").cast("bigint").alias("k"),
        F.coalesce(F.try_divide(F.try_divide(F.coalesce("_hits", F.lit(0)), F.least("k", size)), total), F.lit(0.0)).alias("precision"))


def _best_matches(open_: DataFrame, found: Search) -> DataFrame:
    """query_id, _id, _sim of the best candidate of the same label, for queries whose label some candidate has.

    Only cells with that label are visited, and in them the candidates of the label: first the one with the best bound, unless a match is known already (`_seen`), then those
    whose bound reaches the match found.
    """
    cells = found.cells
    # a label is in as many cells as there are, so its list is bounded
    where = cells.rows.filter("label is not null").groupBy("label").agg(F.collect_set("cell").alias("_in"))
    known, lanes = stored(lookup(open_, where, ["label"])), found.grid.lanes

    def inside(b, high):
        lists = b.column("_in")
        out = np.zeros(high.shape, bool)
        out[np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = True
        return out

    def one(low, high, b):
        best = np.where(inside(b, high), high, -3.0).argmax(axis=1)
        return np.arange(high.shape[1]) == best[:, None]

    def reaching(low, high, b):
        return inside(b, high) & (high + NEAR >= np.asarray(b.column("_seen")).astype(float)[:, None])

    near = _search(deal(known.filter("_seen is null"), cells, lanes, one), cells, found.grid, 1, ("match",))
    seen = _merge(near, "match", 1).select("query_id", F.col("similarity").alias("_new"))
    wider = known.join(seen, "query_id", "left").withColumn("_seen", F.coalesce("_seen", "_new")).drop("_new")
    hits = _search(deal(stored(wider), cells, lanes, reaching), cells, found.grid, 1, ("match",))
    return _merge(hits, "match", 1).select("query_id", F.col("candidate_id").alias("_id"), F.col("similarity").alias("_sim"))


def reciprocal_ranks(found: Search, k: int) -> DataFrame:
    """1 / rank of the first same-label candidate per query; 0 without one.

    When that candidate is among the k best, its rank is known. For the other queries it is searched for in the cells that have the label; then
    the candidates ahead of it are counted: cells whose lower bound is above it count whole, those whose upper bound is below not at all, and
    only the cells between are visited.
    """
    cells = found.cells
    known = _merge(found.hits, "top", k).filter("same").groupBy("query_id").agg(F.min("rank").alias("_rank"))
    seen = _merge(found.hits, "match", 1).select("query_id", F.col("similarity").alias("_seen"))
    state = stored(found.queries.join(known, "query_id", "left").join(seen, "query_id", "left"))
    open_ = state.filter("_rank is null").select("query_id", "label", "embedding", "_seen")
    if open_.isEmpty():
        far = state.select("query_id", F.lit(None).cast("bigint").alias("_far"))
    else:
        best = stored(_best_matches(open_, found))
        far = _ranks_by_count(open_.select("query_id", "label", "embedding").join(best, "query_id"), cells, found.grid)
    rank = F.coalesce(F.col("_rank").cast("bigint"), F.col("_far"))
    return state.join(far, "query_id", "left").select(
        "query_id", F.coalesce(F.try_divide(F.lit(1.0), rank), F.lit(0.0)).alias("reciprocal_rank"))


def _ranks_by_count(queries: DataFrame, cells: Cells, grid: Grid) -> DataFrame:
    """query_id, _far: the rank of candidate `_id`, whose similarity is `_sim`."""

    def start(held: Held) -> dict:
        return {"held": held, "own": np.asarray(held.rows["_sim"]), "id": _ids(held.rows["_id"].combine_chunks()), "ahead": np.asarray(held.rows["_whole"]).copy()}

    def visit(state: dict, rows: np.ndarray, piece: Piece) -> None:
        for i, sims in strips(rows, state["held"], piece):
            own = state["own"][i][:, None]
            above, reach = sims > own + HALF, sims >= own - HALF
            n, all_ = [np.bitwise_count(np.packbits(x, axis=1)).sum(axis=1, dtype=np.int64) for x in (above, reach)]
            # equal ones count by their ids
            tied = np.flatnonzero(n < all_)
            if len(tied):
                row, col = np.nonzero(reach[tied] & ~above[tied])
                before = piece.ids[col] < state["id"][i[tied[row]]]
                n[tied] += np.bincount(row[before.astype(bool)], minlength=len(tied))
            state["ahead"][i] += n

    def finish(state: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([state["held"].rows["query_id"].combine_chunks(), pa.array(state["ahead"])], ["query_id", "ahead"])

    def between(low, high, b):
        return high + NEAR >= np.asarray(b.column("_sim"))[:, None]

    kind = queries.schema["query_id"].dataType.simpleString()
    dealt = deal(queries, cells, grid.lanes, between, whole=True)
    counted = meet(dealt, cells, grid, f"query_id {kind}, ahead bigint", start, visit, finish)
    return counted.groupBy("query_id").agg((F.sum("ahead") + 1).alias("_far"))


def evaluate(queries: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), id_col: str = "id",
             label: str = "label", vec: str = "embedding", block: int | None = None, pivots: int = PIVOTS) -> DataFrame:
    """One row: mean precision per k, mean reciprocal rank, number of queries."""
    q, c = _sides(queries, candidates, id_col, label, vec)
    k = max(ks)
    found = search(q, c, k, block, pivots)
    total, size = found.n_queries, int(found.cells.size.sum())
    wide = precision_at_k(_merge(found.hits, "top", k), total, ks, size).agg(
        *[F.max(F.when(F.col("k") == x, F.col("precision"))).alias(f"precision_at_{x}") for x in ks])
    mrr = reciprocal_ranks(found, k).agg(
        F.avg("reciprocal_rank").alias("mrr"), F.count(F.lit(1)).alias("sample_count"))
    return beside(wide, mrr)
