"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints within `distance` bits agree on at least one of distance + 1 bands. For every band, fingerprints are
rotated so that the band leads, and sorted by Gray rank over the whole table, so neighbours share bits. A band's
group is cut into blocks of at most BLOCK; the shared masked bits of every 16 neighbours go up into a node, those
of 16 nodes into the next, up to the block. Two nodes are compared on the bits both mask; if the differences there
exceed the distance, all pairs below are pruned at once. Blocks of one group are paired by the same test. A block
(or pair) hands on a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threadgrove.llm.common import utf8
from threadgrove.llm.connected import components
from threadgrove.session import stored

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
BLOCK = 4096
FAN = 16
PAIRS = 1 << 21
PIECE = 1 << 18
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half the XXH64 hashes of the word shingles; 0 without words."""
    import xxhash

    words = data.translate(LOWER).split()
    if not words:
        return 0
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    after = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(a + 1 for a in after[:-1])]
    ends = after[min(shingle, len(words)) - 1:]
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(ends), PIECE):
        hashes = np.array([of(joined[s:e], SEED) for s, e in zip(starts[a:a + PIECE], ends[a:a + PIECE])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; a null text has no words."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data = utf8(b.column("text"))
            found = np.array([simhash(data[at[i]:at[i + 1]].tobytes()) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(hash_texts, f"doc_id {kind}, fp bigint")


def nodes_above(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the fingerprints up: (pattern, mask of the bits that all below share), FAN below each."""
    ands, ors = fps, fps
    levels = [(fps, np.full(len(fps), np.uint64(2**64 - 1)))]
    while len(ands) > FAN:
        at = np.arange(0, len(ands), FAN)
        ands, ors = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
        levels.append((ands, ~(ands ^ ors)))
    return levels


def close_pairs(a: np.ndarray, b: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints within the distance, i < j if `b` is None; bounded arrays, one after another."""
    same = b is None
    la, lb = nodes_above(a), nodes_above(a if same else b)
    while len(la) < len(lb):
        la.append(la[-1] if len(la[-1][0]) == 1 else _joined(la[-1]))
    while len(lb) < len(la):
        lb.append(lb[-1] if len(lb[-1][0]) == 1 else _joined(lb[-1]))
    i, j = np.meshgrid(np.arange(len(la[-1][0])), np.arange(len(lb[-1][0])), indexing="ij")
    todo = [(len(la) - 1, i.ravel(), j.ravel())]
    spread = np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN)
    while todo:
        level, i, j = todo.pop()
        (pa_, ma), (pb, mb) = la[level], lb[level]
        if same:
            ordered = i < j if level == 0 else i <= j
            i, j = i[ordered], j[ordered]
        near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= distance
        i, j = i[near], j[near]
        if level == 0:
            if len(i):
                yield i, j
            continue
        sizes = len(la[level - 1][0]), len(lb[level - 1][0])
        for at in range(0, len(i), PAIRS // (FAN * FAN)):
            x = (i[at:at + PAIRS // (FAN * FAN), None] * FAN + spread[0]).ravel()
            y = (j[at:at + PAIRS // (FAN * FAN), None] * FAN + spread[1]).ravel()
            inside = (x < sizes[0]) & (y < sizes[1])
            todo.append((level - 1, x[inside], y[inside]))


def _joined(level: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One node above all of a level."""
    pattern, mask = level
    low, high = np.bitwise_and.reduce(pattern & mask), np.bitwise_or.reduce(pattern & mask)
    shared = np.bitwise_and.reduce(mask) & ~(low ^ high)
    return np.array([low & shared]), np.array([shared])


def spanning(a: np.ndarray, b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that connect what the close pairs connect; `b` counts on after `a`."""
    root = np.arange(len(a) + (0 if b is None else len(b)))
    for i, j in close_pairs(a, b, distance):
        j = j if b is None else j + len(a)
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def _bands(distance: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of distance + 1 bands of nearly equal width."""
    edges = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _gray_rank(value) -> F.Column:
    """Rank of a 64-bit pattern in Gray order, shifted so that signed order is its order."""
    for s in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, s))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """u, v: ids of linked fingerprints that connect all within `distance` bits. `nodes`: id, fp, each fp once."""
    bands = _bands(distance)
    turned = F.array(*[F.struct(F.lit(k).alias("band"), _gray_rank(
        F.col("fp") if not at else F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", BITS - at))).alias("rank")) for k, (at, _) in enumerate(bands)])
    ranked = nodes.select("id", F.explode(turned).alias("t")).select(F.col("t.band").alias("band"), F.col("t.rank").alias("rank"), "id")
    ordered = ranked.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")
    widths = np.array([w for _, w in bands])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside every block; blocks whose group may go on elsewhere are handed on too."""
        task, number = TaskContext.get().partitionId() << 32, 0
        held: tuple | None = None
        first = True

        def finish(band, key, fps, ids, alone):
            nonlocal number
            out_u, out_v, blocks = [], [], []
            parts = range(0, len(fps), block)
            for a in parts:
                f, d = fps[a:a + block], ids[a:a + block]
                x, y = spanning(f, None, distance)
                out_u.append(d[x])
                out_v.append(d[y])
                if not alone or len(parts) > 1:
                    low, high = np.bitwise_and.reduce(f), np.bitwise_or.reduce(f)
                    blocks.append((int(band), int(key), task + number, int(low.view(np.int64)), int((~(low ^ high)).view(np.int64)), f.tobytes(), d.tobytes()))
                    number += 1
            return out_u, out_v, blocks

        def rows(us, vs, blocks):
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            n, m = len(u), len(blocks)
            column = lambda k, t: pa.array([None] * n + [b[k] for b in blocks], t)
            return pa.RecordBatch.from_arrays(
                [pa.array(u.tolist() + [None] * m, pa.int64()), pa.array(v.tolist() + [None] * m, pa.int64()), column(0, pa.int32()), column(1, pa.int64()),
                 column(2, pa.int64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.binary()), column(6, pa.binary())],
                ["u", "v", "band", "key", "block", "pattern", "mask", "fps", "ids"])

        for b in batches:
            if not b.num_rows:
                continue
            band = b.column("band").to_numpy().astype(np.int64)
            rank = b.column("rank").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            fps = rank ^ (rank >> np.uint64(1))
            key = (fps >> (np.uint64(BITS) - widths[band].astype(np.uint64))).astype(np.int64)
            ids = b.column("id").to_numpy().astype(np.int64)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(band) != 0)) + 1
            us, vs, blocks = [], [], []
            for s, e in zip([0, *cuts], [*cuts, len(key)]):
                part = (band[s], key[s], fps[s:e], ids[s:e])
                if held is not None and held[:2] == part[:2]:
                    held = (*held[:2], held[2] + [part[2]], held[3] + [part[3]], held[4])
                    # a group longer than a block goes on as blocks, so that no group is held whole
                    if sum(map(len, held[2])) > block:
                        f, d = np.concatenate(held[2]), np.concatenate(held[3])
                        whole = len(f) // block * block
                        x = finish(held[0], held[1], f[:whole], d[:whole], False)
                        us, vs, blocks = us + x[0], vs + x[1], blocks + x[2]
                        held = (held[0], held[1], [f[whole:]], [d[whole:]], False)
                    continue
                if held is not None:
                    x = finish(held[0], held[1], np.concatenate(held[2]), np.concatenate(held[3]), held[4])
                    us, vs, blocks = us + x[0], vs + x[1], blocks + x[2]
                held, first = (part[0], part[1], [part[2]], [part[3]], not first), False
            yield rows(us, vs, blocks)
        if held is not None:
            yield rows(*finish(held[0], held[1], np.concatenate(held[2]), np.concatenate(held[3]), False))

    found = stored(ordered.mapInArrow(index, "u bigint, v bigint, band int, key bigint, block bigint, pattern bigint, mask bigint, fps binary, ids binary"))
    blocks = found.filter(F.col("block").isNotNull())
    narrow = blocks.select("band", "key", "block", "pattern", "mask")
    other = narrow.select("band", "key", F.col("block").alias("other"), F.col("pattern").alias("pattern2"), F.col("mask").alias("mask2"))
    differences = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    paired = narrow.join(other, ["band", "key"]).filter((F.col("block") < F.col("other")) & (differences <= distance)).select("block", "other")
    left = blocks.select("block", F.col("fps").alias("fps_a"), F.col("ids").alias("ids_a"))
    right = blocks.select(F.col("block").alias("other"), F.col("fps").alias("fps_b"), F.col("ids").alias("ids_b"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y = spanning(np.frombuffer(r["fps_a"], np.uint64), np.frombuffer(r["fps_b"], np.uint64), distance)
                ids = np.concatenate([np.frombuffer(r["ids_a"], np.int64), np.frombuffer(r["ids_b"], np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["u", "v"])

    crossed = paired.join(left, "block").join(right, "other").select("fps_a", "ids_a", "fps_b", "ids_b").mapInArrow(across, "u bigint, v bigint")
    return found.filter(F.col("u").isNotNull()).select("u", "v").unionAll(crossed)


def near_duplicates(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links, itself included).

    Fingerprints that differ in at most `distance` bits are linked; texts without words all have fingerprint 0. Rows
    without an id get a fingerprint but take no part in links: their component_id is null. Repeated rows are linked like equal texts.
    Rows with equal ids and different texts are one document, so what either is linked to is connected. Only doc_id and text are read.
    """
    found = stored(fingerprints(documents))
    nodes = stored(found.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes, distance))
    place = nodes.join(roots, nodes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return found.join(place, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of `documents`, all columns, whose doc_id is the smallest of their group; of repeated ids the first by text.

    Rows without an id are kept: they take no part in links.
    """
    kept = near_duplicates(documents, distance).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"))
    named = whole.filter(F.col("_row.doc_id").isNotNull()).join(kept, F.col("_row.doc_id") == F.col("_kept"), "left_semi")
    first = F.row_number().over(Window.partitionBy("_row.doc_id").orderBy("_row.text"))
    named = named.withColumn("_first", first).filter(F.col("_first") == 1).select("_row.*")
    return named.unionAll(documents.filter(F.col("doc_id").isNull()))
