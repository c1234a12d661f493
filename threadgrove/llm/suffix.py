"""Repeated substrings of a corpus by a difference-cover sample of its suffixes.

Every byte position of a document is a suffix. A difference cover of residues modulo PERIOD has, for any two
positions, a common shift below PERIOD that puts both into the sample. So two equal strings of `length` bytes hold a
pair of sampled suffixes that agree on length - PERIOD + 1 bytes. The steps:

1. The sampled suffixes get the names of their first length - PERIOD + 1 bytes; names are sorted and compared with
   their neighbours, and those that occur once are dropped.
2. The remaining suffixes that such a repeated sample can vouch for are merged in: each gets the name of its first `length` bytes,
   made from the same prefix sums.
3. Names are sorted again, neighbours with equal prefixes are repeats, and the bytes below them are removed.

Names are order-free 60-bit hashes, so sorting by name is a sort of prefixes up to equality, which is all that
matters here; the recursion of the textbook form, which only serves to order equal prefixes, is not needed. Documents travel
once, packed into chunks of a bucketed table; afterwards only sorted names, as differences, go to the name ranges,
and one bit a name comes back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadgrove.llm.common import utf8
from threadgrove.session import shared_dir, stored

LENGTH = 200
# A difference cover of 12 residues modulo 133, each difference once.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
NAME_BITS = 60
CHUNK = 4 << 20
PIECE = 1 << 19
RANGE_BYTES = 16 << 20
GRAMS, TEXTS = 0, 1
_ODD = 0x9E3779B97F4A7C15


def _tables(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word per byte value, and the powers of an odd number and of its inverse."""
    words = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
    grow = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + length, np.uint64(x))]), dtype=np.uint64)
    return words, grow(_ODD), grow(pow(_ODD, -1, 1 << 64))


def names_at(data: np.ndarray, at: np.ndarray, width: int, tables: tuple) -> np.ndarray:
    """Names of the `width` bytes from each position (ascending): differences of prefix sums, mixed to NAME_BITS bits."""
    words, powers, inverse = tables
    out = np.empty(len(at), np.uint64)
    for start in range(0, len(data), PIECE):
        a, b = np.searchsorted(at, (start, start + PIECE))
        if a == b:
            continue
        x = words[data[start:start + PIECE + width]]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * powers[:len(x)], dtype=np.uint64)])
        i = at[a:b] - start
        out[a:b] = (sums[i + width] - sums[i]) * inverse[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return out >> np.uint64(64 - NAME_BITS)


def encode(names: np.ndarray, several: np.ndarray) -> bytes:
    """Ascending names as the first and differences of the least common byte width, after a bit each for `several`."""
    steps = np.diff(names)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    head = np.array([len(names), width], np.uint32).tobytes() + names[:1].tobytes()
    return head + np.packbits(several).tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    count, width = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    bits = -(-count // 8)
    wide = np.zeros((count, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8, 8)
    wide[1:, :width] = np.frombuffer(blob, np.uint8, offset=16 + bits).reshape(-1, width)
    several = np.unpackbits(np.frombuffer(blob, np.uint8, bits, 16), count=count)
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64), several.astype(bool)


class Chunk:
    """Some documents' bytes in a row, and what is known of their suffixes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, tables: tuple, cover: np.ndarray):
        self.data, self.sizes, self.length, self.tables, self.cover = data, sizes, length, tables, cover
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def whole_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of whole documents that are long enough: ascending distinct names, how often, and the name number per document (-1: short)."""
        import xxhash

        number = np.full(len(self.sizes), -1)
        long = np.flatnonzero(self.sizes >= self.length)
        hashed = np.array([xxhash.xxh3_64_intdigest(self.data[self.starts[i]:self.starts[i + 1]]) for i in long], np.uint64) >> np.uint64(64 - NAME_BITS)
        names, number[long], counts = np.unique(hashed, return_inverse=True, return_counts=True)
        return names, counts, number

    def sampled(self) -> np.ndarray:
        """Positions of sampled suffixes with enough bytes left."""
        room = self.sizes - (self.length - PERIOD + 1)
        upto = np.where(room >= 0, np.searchsorted(self.cover, room, side="right"), 0)
        return np.repeat(self.starts[:-1], upto) + self.cover[np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)]

    def vouched(self, repeated: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Positions with `length` bytes left and a repeated sample less than PERIOD after them, in documents not skipped."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, np.maximum(repeated - (PERIOD - 1), 0), 1)
        np.add.at(edge, repeated + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        tail = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(tail, np.maximum(self.starts[1:] - (self.length - 1), self.starts[:-1]), 1)
        np.add.at(tail, self.starts[1:], -1)
        near &= np.cumsum(tail[:-1]) == 0
        near &= ~np.repeat(skip, self.sizes)
        return np.flatnonzero(near)


def _unique(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct names, and whether each occurs several times."""
    ordered = np.sort(names)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return ordered[at], np.diff(np.concatenate([at, [len(ordered)]])) > 1


def _member(sorted_names: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names are among the sorted ones; a bitmap of their low bits answers most."""
    if not len(sorted_names):
        return np.zeros(len(names), bool)
    bits = 22
    seen = np.zeros(1 << bits, bool)
    seen[(sorted_names & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    out = seen[(names & np.uint64((1 << bits) - 1)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(sorted_names, names[maybe])
    out[maybe] = sorted_names[np.minimum(at, len(sorted_names) - 1)] == names[maybe]
    return out


def _bits_of(found: list[dict] | None, kind: int, names: np.ndarray, ranges: int, field: str = "repeated") -> np.ndarray:
    """The bits that came back for ascending names, range by range."""
    cuts = np.searchsorted(names >> np.uint64(NAME_BITS - ranges), np.arange((1 << ranges) + 1))
    out = np.zeros(len(names), bool)
    for f in found or []:
        if f["kind"] == kind:
            a, b = cuts[f["range"]], cuts[f["range"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(f[field], np.uint8), count=int(b - a))
    return out


def _by_range(kind: int, names: np.ndarray, several: np.ndarray, ranges: int) -> Iterator[tuple[int, int, bytes]]:
    cuts = np.searchsorted(names >> np.uint64(NAME_BITS - ranges), np.arange((1 << ranges) + 1))
    for r in np.flatnonzero(np.diff(cuts)):
        yield kind, int(r), encode(names[cuts[r]:cuts[r + 1]], several[cuts[r]:cuts[r + 1]])


def _compare(named: DataFrame) -> DataFrame:
    """chunk, found: per name list of a chunk one bit a name, whether it occurs elsewhere or several times there, and
    whether the chunk is the first with it. One task sorts the names of one range of one kind."""

    def neighbours(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        chunks = rows.column("chunk").to_numpy()
        order = np.argsort(chunks, kind="stable")
        lists = [decode(b) for b in (x.as_py() for x in rows.column("names"))]
        sizes = np.array([len(n) for n, _ in lists])
        lists = [lists[i] for i in order]
        names = np.concatenate([n for n, _ in lists])
        several = np.concatenate([s for _, s in lists])
        by_name = np.argsort(names, kind="stable")
        ordered = names[by_name]
        same = ordered[1:] == ordered[:-1]
        repeated, first = several, np.zeros(len(names), bool)
        repeated[by_name[1:][same]] = True
        repeated[by_name[:-1][same]] = True
        first[by_name[np.concatenate([[True], ~same])]] = True
        ends = np.cumsum(sizes[order])[:-1]
        pack = lambda x: [np.packbits(p).tobytes() for p in np.split(x, ends)]
        n = len(order)
        return pa.table({"chunk": pa.array(chunks[order]), "kind": pa.array([key[0].as_py()] * n, pa.int32()), "range": pa.array([key[1].as_py()] * n, pa.int32()),
                         "repeated": pa.array(pack(repeated), pa.binary()), "first": pa.array(pack(first), pa.binary())})

    bits = named.groupBy("kind", "range").applyInArrow(neighbours, "chunk bigint, kind int, range int, repeated binary, first binary")
    return bits.groupBy("chunk").agg(F.collect_list(F.struct("kind", "range", "repeated", "first")).alias("found"))


def _chunks(documents: DataFrame) -> DataFrame:
    """chunk, ids, sizes, data: documents packed in reading order, as a bucketed table whose files are in the shared folder.

    Bucketed by chunk, it meets the bits that come back for its chunks without being shuffled.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, kind, size = [], [], pa.int64(), 0

        def row():
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.array([ids], pa.list_(kind)), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["chunk", "ids", "sizes", "data"])

        for b in batches:
            at, data = utf8(b.column("text"))
            kind = b.column("doc_id").type
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                text = data[at[i]:at[i + 1]].tobytes()
                if parts and size + len(text) > CHUNK:
                    yield row()
                    ids, parts, size = [], [], 0
                ids.append(d)
                parts.append(text)
                size += len(text)
        if parts:
            yield row()

    spark = documents.sparkSession
    name = f"threadgrove_chunks_{uuid.uuid4().hex}"
    packed = documents.select("doc_id", "text").mapInArrow(pack, f"chunk bigint, ids array<{id_type}>, sizes array<bigint>, data binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/threadgrove-{spark.sparkContext.applicationId}/{name}"
    packed.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name)


def repeated_substrings(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (start, length of removed runs), kept (the other bytes) of every row.

    A byte goes if a string of `length` bytes that covers it also starts at another place of any document, the
    same included. `length` is above PERIOD. Null texts are empty; texts shorter than `length` keep everything; repeated
    rows remove each other; ids only name the rows, so they may be null or repeated, and further columns are not read.
    Exact copies are found by whole names first and only one of them goes on.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be above {PERIOD}")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    chunks = _chunks(documents)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(1, (total // RANGE_BYTES).bit_length())
    head = length - PERIOD + 1

    def of(batches: Iterator[pa.RecordBatch], tables) -> Iterator[tuple[dict, Chunk]]:
        cover = np.zeros(0, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names if c != "data"}
                sizes = np.array(r["sizes"], np.int64)
                if len(sizes) and sizes.max() > len(cover) * PERIOD // len(COVER) - PERIOD:
                    cover = (np.arange(sizes.max() // PERIOD + 2)[:, None] * PERIOD + np.array(COVER)).ravel()
                yield r, Chunk(np.frombuffer(b.column("data")[i].as_buffer(), np.uint8), sizes, length, tables, cover)

    def samples(chunk: Chunk, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = chunk.sampled()
        names = names_at(chunk.data, at, head, tables)
        return at, names, *_unique(names)

    def name_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(length)
        for r, chunk in of(batches, tables):
            names, counts, _ = chunk.whole_names()
            rows = [*_by_range(GRAMS, *samples(chunk, tables)[2:], ranges), *_by_range(TEXTS, names, counts > 1, ranges)]
            yield _named(r["chunk"], rows)

    def suffixes(chunk: Chunk, found: list[dict] | None, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each document is a copy of another, the positions merged in, and their names."""
        names, counts, number = chunk.whole_names()
        copied, earliest = (_bits_of(found, TEXTS, names, ranges, f) for f in ("repeated", "first"))
        known = number >= 0
        is_copy, skip = np.zeros(len(number), bool), np.zeros(len(number), bool)
        is_copy[known] = copied[number[known]]
        skip[known] = ~earliest[number[known]]
        _, leaders = np.unique(number[known], return_index=True)
        follows = np.ones(int(known.sum()), bool)
        follows[leaders] = False
        skip[known] |= follows
        at, sampled, distinct, _ = samples(chunk, tables)
        repeated = distinct[_bits_of(found, GRAMS, distinct, ranges)]
        places = chunk.vouched(at[_member(repeated, sampled)], skip)
        return is_copy, places, names_at(chunk.data, places, length, tables)

    def name_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(length)
        for r, chunk in of(batches, tables):
            yield _named(r["chunk"], list(_by_range(GRAMS, *_unique(suffixes(chunk, r["found"], tables)[2]), ranges)))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(length)
        for r, chunk in of(batches, tables):
            is_copy, places, names = suffixes(chunk, r["found"], tables)
            distinct, _ = _unique(names)
            places = places[_member(distinct[_bits_of(r["again"], GRAMS, distinct, ranges)], names)]
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            edge[places] += 1
            np.add.at(edge, places + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            gone |= np.repeat(is_copy, chunk.sizes)
            yield _cleaned(r["ids"], chunk, gone, id_type)

    named = chunks.mapInArrow(name_samples, "chunk bigint, kind int, range int, names binary")
    found = stored(_compare(named))
    informed = chunks.join(found.hint("shuffle_hash"), "chunk", "left")
    again = stored(_compare(informed.mapInArrow(name_suffixes, "chunk bigint, kind int, range int, names binary")))
    again = again.withColumnRenamed("found", "again")
    informed = informed.join(again.hint("shuffle_hash"), "chunk", "left")
    return informed.mapInArrow(remove, f"doc_id {id_type}, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary")


def _named(chunk: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, names = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(names, pa.binary())],
                                      ["chunk", "kind", "range", "names"])


def _cleaned(ids: list, chunk: Chunk, gone: np.ndarray, id_type: str) -> pa.RecordBatch:
    """The result rows of a chunk: runs of removed bytes and the bytes that stay, per document."""
    spans, kept = [], []
    for a, b in zip(chunk.starts[:-1], chunk.starts[1:]):
        g = gone[a:b]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
        spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turns[::2], turns[1::2])])
        kept.append(chunk.data[a:b][~g].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, {"string": pa.string(), "int": pa.int32()}.get(id_type, pa.int64())),
                                       pa.array(chunk.sizes), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
