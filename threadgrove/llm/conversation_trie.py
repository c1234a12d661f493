"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its key is its depth and two prefix sums (exclusive or) of 64-bit hashes of its
turns, each of depth, role and text; 10^10 nodes hold two with one key with a chance of about 10^-19. Its representative is
its smallest member, so (conv_id, depth) names a node as well.

Totals flow from the leaves to the root. Conversations are dealt to shards; a shard has the paths of its conversations and the own values
of the nodes that they represent. It sorts the nodes by reverse level order (Spark's external sort) and reads them once: a node takes
what its children have sent out of a priority queue, adds its own, and sends the sum to its parent. The queue spills
sorted runs to a file of the task. A node near the root is in many shards; the totals that each shard has for it are
added up afterwards, first within the tasks, so no subtree is ever one group. Conversations of more than BAND turns are cut
into bands, which run from the deepest on and hand the totals of their upper ends on.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadgrove.llm.mixing import words
from threadgrove.operators.skew import lookup
from threadgrove.session import stored

CELL = 1 << 16
BAND = 1 << 20
QUEUE = 1 << 18
READ = 1 << 12
PIECE = 1 << 12
KEY = ["depth", "p1", "p2"]
TOTALS = ["leaves", "saved", "children"]


class SpillingQueue:
    """Items in ascending order. Beyond `most` items in memory, all go to a sorted run in a file of this task, which is
    read again in parts; a task that is run again on another executor writes its own."""

    def __init__(self, most: int = QUEUE, folder: str | None = None):
        self.most, self.folder = most, folder
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            run = self._run(self.heap)
            self.heap = []
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    def _run(self, items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile(dir=self.folder)
        for first in range(0, len(items), READ):
            pickle.dump(items[first:first + READ], file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(0, n, READ):
                    yield from pickle.load(file)

        n = len(items)
        return read()

    def _next(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heappush(self.heads, (item, run))

    def first(self) -> tuple | None:
        least = self.heads[0][0] if self.heads else None
        return self.heap[0] if self.heap and (least is None or self.heap[0] <= least) else least

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heappop(self.heads)
            self._next(run)
            return item
        return heappop(self.heap)


def spill_folder() -> str | None:
    """Where Spark's own spills of this task go."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, digest, words for every turn.

    Order: turn (null first), then role, then the digest of the text. Null role and text are empty; rows without
    conv_id are in no conversation and left out; repeated rows are turns of their own. The rows are cut into ranges of (conv_id, turn, …) at edges from the data, so
    a conversation with a third of all turns is numbered in many tasks; the ranges are written, so they stay as they are.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("digest"),
        words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    cut = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return stored(cut.withColumn("inside", inside).join(offsets, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("depth"), "role", "digest", "words"))


def keyed(turns: DataFrame) -> DataFrame:
    """conv_id, depth, p1, p2 (key with depth), q1, q2 (the parent's), words for every turn; sums are taken in cells of depth."""
    hashed = turns.select("conv_id", "depth", "words", F.floor((F.col("depth") - 1) / CELL).alias("cell"),
                          *[F.xxhash64(F.lit(k), "depth", "role", "digest").alias(f"t{k}") for k in (1, 2)])
    cells = hashed.groupBy("conv_id", "cell").agg(*[F.bit_xor(f"t{k}").alias(f"c{k}") for k in (1, 2)], F.max("cell").alias("_"))
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("conv_id", "cell", *[F.bit_xor(f"c{k}").over(earlier).alias(f"o{k}") for k in (1, 2)]).filter("cell > 0")
    inside = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.select("*", *[F.bit_xor(f"t{k}").over(inside).alias(f"s{k}") for k in (1, 2)]).join(offsets, ["conv_id", "cell"], "left")
    p = [F.col(f"s{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0).cast("bigint"))) for k in (1, 2)]
    return sums.select("conv_id", F.col("depth").cast("bigint").alias("depth"), *[p[k].alias(f"p{k + 1}") for k in (0, 1)],
                       *[p[k].bitwiseXOR(F.col(f"t{k + 1}")).alias(f"q{k + 1}") for k in (0, 1)], "words")


def _kind(column: str, df: DataFrame) -> str:
    return df.schema[column].dataType.simpleString()


def ends(last: DataFrame) -> DataFrame:
    """depth, p1, p2, n_ends, ends_sha256 (of the ascending ids, comma-joined) of the nodes where conversations end.

    Ids are sorted and joined in ranges of (node, id), then the joined pieces of each node are hashed in order: the one
    task that SHA-256 leaves to a node reads text, not rows, and holds one piece at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in (*KEY, "conv_id")])
            out = []
            for key, group in groupby(rows, lambda r: r[:3]):
                ids = [r[3] for r in group]
                out += [(*key, ids[i], len(ids[i:i + PIECE]), ",".join(map(str, ids[i:i + PIECE]))) for i in range(0, len(ids), PIECE)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), b.column("conv_id").type, pa.int64(), pa.string()))],
                                                 [*KEY, "first", "n", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in (*KEY, "n", "ids")]))
        out = []
        for key, group in groupby(rows, lambda r: r[:3]):
            n, sha = 0, hashlib.sha256()
            for r in group:
                sha.update((("," if n else "") + r[4]).encode())
                n += r[3]
            out.append((*key, n, sha.hexdigest()))
            if len(out) == READ:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "n_ends", "ends_sha256"])

    key = ", ".join(f"{k} bigint" for k in KEY)
    pieces = last.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(
        join, f"{key}, first {_kind('conv_id', last)}, n bigint, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, n_ends bigint, ends_sha256 string")


def totals_in_shards(rows: DataFrame, least: int, queue: int = QUEUE) -> DataFrame:
    """depth, p1, p2, conv_id, leaves, saved, children, open: what each shard has for its nodes of more than `least` turns; `open` rows are
    what these send to nodes of `least` turns.

    `rows` are the shards' nodes: KEY, the parent's q1 and q2 (null where only values are sent), conv_id, own values, `own` (whether the node is
    represented here). A conversation's rows and those of the nodes that it represents are in one partition.
    """

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(queue, spill_folder())
        out: list[tuple] = []

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*KEY, "conv_id", *TOTALS, "open"])
            out.clear()
            return b

        def sent(key: tuple) -> Iterator[tuple]:
            while (item := waiting.first()) is not None and item[:3] == key:
                yield waiting.pop()

        kind = pa.int64()

        def read() -> Iterator[tuple]:
            nonlocal kind
            for b in batches:
                kind = b.column("conv_id").type
                yield from zip(*[b.column(c).to_pylist() for c in (*KEY, "q1", "q2", "conv_id", *TOTALS, "own")])

        for (depth, p1, p2), group in groupby(read(), lambda r: r[:3]):
            leaves = saved = children = 0
            own, parent = False, None
            for *_, q1, q2, conv, n, s, c, mine in group:
                leaves, saved, children, own = leaves + n, saved + s, children + c, own or mine
                parent = (q1, q2, conv) if q1 is not None else parent
            for *_, n, s, c in sent((-depth, p1, p2)):
                leaves, saved, children = leaves + n, saved + s, children + c
            if not (own or leaves or saved or children):
                continue
            q1, q2, conv = parent
            out.append((depth, p1, p2, conv, leaves, saved, children, False))
            waiting.push((1 - depth, q1, q2, conv, leaves, saved, int(own)))
            if len(out) >= READ:
                yield flush(kind)
        while waiting.first() is not None:
            up, *rest = waiting.pop()
            out.append((-up, *rest, True))
            if len(out) >= READ:
                yield flush(kind)
        if out:
            yield flush(kind)

    dealt = rows.filter(F.col("depth") > least).repartition("conv_id").sortWithinPartitions(F.desc("depth"), "p1", "p2")
    kinds = ", ".join(f"{c} bigint" for c in TOTALS)
    return dealt.mapInArrow(flow, f"{', '.join(f'{k} bigint' for k in KEY)}, conv_id {_kind('conv_id', rows)}, {kinds}, open boolean")


def subtree_totals(paths: DataFrame, nodes: DataFrame, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """KEY, leaves, saved, children of all nodes, the root included: within shards, band by band, then over the shards."""
    none = [F.lit(0).cast("bigint").alias(c) for c in TOTALS]
    own = nodes.select(*KEY, "q1", "q2", "conv_id", F.col("leaf").cast("bigint").alias("leaves"), F.col("own_saved").alias("saved"), none[2], F.lit(True).alias("own"))
    rows = paths.select(*KEY, "q1", "q2", "conv_id", *none, F.lit(False).alias("own")).unionAll(own)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    found, up = [], None
    for least in range(max(0, deepest - 1) // band * band, -1, -band):
        here = rows.filter(F.col("depth") <= least + band)
        if up is not None:
            null = F.lit(None).cast("bigint")
            here = here.unionAll(up.select(*KEY, null.alias("q1"), null.alias("q2"), "conv_id", *TOTALS, F.lit(False).alias("own")))
        done = stored(totals_in_shards(here, least, queue))
        up = done.filter("open")
        found.append(done.filter(~F.col("open")))
    for f in found[1:]:
        found[0] = found[0].unionAll(f)
    return found[0].unionAll(up).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in TOTALS])


def trie(turns: DataFrame, members: DataFrame, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (of the parent, null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last text), ends_sha256.

    `turns` has conv_id, depth (1, 2, … in each conversation), role, digest (of the text), words, without nulls, as `numbered` gives
    them; `members` all conversations, also those without turns. Without members there is no node, not even the root.
    """
    paths = stored(keyed(turns))
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k")).select("conv_id", "k.*")
    zero = [F.lit(0).cast("bigint").alias(k) for k in KEY]
    last = members.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(k, z).alias(k) for k, z in zip(KEY, zero)])
    at_root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        *zero, "conv_id", "n_convs", *[F.lit(None).cast("bigint").alias(q) for q in ("q1", "q2")], F.lit(0).cast("bigint").alias("own_saved"))
    inner = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
                                    F.max("words").alias("words"))
    inner = inner.select(*KEY, "conv_id", "n_convs", "q1", "q2", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"))
    nodes = stored(inner.unionAll(at_root).join(ends(last), KEY, "left").withColumn("leaf", F.coalesce(F.col("n_ends") == F.col("n_convs"), F.lit(False))))
    totals = subtree_totals(paths, nodes.filter("depth > 0"), band, queue)
    known = stored(nodes.join(totals, KEY, "left"))
    above = known.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    up = ["depth", "q1", "q2"]
    counts = known.groupBy(*up).agg(F.count(F.lit(1)).alias("_n"))
    # a prompt that a third of all nodes follow directly is one parent
    out = lookup(known, above, up, "left", counts=counts)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("children", F.lit(0)).cast("bigint").alias("n_children"),
                      F.when(F.col("depth") > 0, F.col("leaves")).otherwise(F.coalesce("leaves", F.col("leaf").cast("bigint"))).cast("bigint").alias("n_leaves"),
                      F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """`trie` of conv_id, turn, role, text as they are; nulls, ties and repeated rows as in `numbered`, other columns are not read."""
    turns = numbered(conversations)
    return trie(turns, turns.select("conv_id").distinct())
