"""Order-preserving packing of tokenised documents into sequences, by dynamic programming over cut places.

Documents stay in order of doc_id; each is its token ids and an end id. The stream is cut into windows of at most
`capacity` ids. A window costs its padding (none when it is full or its length is a power of two) and a truncation
penalty for where it ends: nothing at a document's end, little at a sentence's, more inside a sentence. The cheapest
cuts come from one sweep: among all starts within reach, a monotone queue holds the smallest cost plus position;
starts at a power-of-two distance are looked up besides. Ranges of documents are packed side by side.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.llm.common import groups_of, texts

CAPACITY = 4096
END_ID = 2
SENTENCE_COST = 8
INNER_COST = 96
GAP = 256
BLOCK_CHARS = 1 << 20
RANGE_BYTES = 32 << 20
SEGMENTS = 1 << 10
SPLIT = 1 << 6
REMEMBERED = 500_000
LEARNED = 20_000
SENTENCE_ENDS = (".", "!", "?")
MARKS = ".,!?;:*#$%&"
SHORTEST = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Words that no normalisation changes and no rule splits.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


class Numbers(dict):
    """Numbers for pieces in the order in which they come up; `new` lists those not looked at yet."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Pieces:
    """Token ids of pieces of text between which this kind of tokenizer always separates tokens: at blanks, and between a letter
    a-z and the run of marks that ends a word. So the ids of a text are the ids of its pieces in a row, and each distinct
    word is tokenised once. A-Z are lowered first, as the tokenizer does, unless the text may hold a special token.
    Plain words go to the merges of the tokenizer directly, all others through its rules. A tokenizer without
    lower case and ends of words is an error: its texts could not be cut like this."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        if '"Lowercase"' not in str(self.tokenizer.normalizer.__getstate__()) or not self.tokenizer.model.end_of_word_suffix:
            raise ValueError(f"{path}: not a lower-case tokenizer with ends of words")
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if PLAIN.fullmatch(c)}
        self.merge = self.tokenizer.model.tokenize
        self.reset()

    def reset(self) -> None:
        self.number = Numbers({"": 0, "\n": 1, None: 2})
        self.number.new = []
        self.words: dict[str, tuple[int, ...]] = {"": ()}
        self.ids, self.starts = array("I", [self.end_id]), array("q", [0, 0, 0, 1])
        self.costs = array("q", [INNER_COST, SENTENCE_COST, 0])

    def learn(self) -> None:
        """Ids and costs of the new pieces; their words and mark runs go to the tokenizer together."""
        words, parts = self.words, []
        for piece in self.number.new:
            word = piece.rstrip(MARKS)
            # after anything but a letter a-z, marks may belong to the token before them
            parts.append((word, piece[len(word):]) if "a" <= word[-1:] <= "z" else (piece, ""))
        asked = []
        for word in dict.fromkeys(chain.from_iterable(parts)):
            if word not in words:
                if PLAIN.fullmatch(word):
                    words[word] = tuple([t.id for t in self.merge(word.translate(self.letters))])
                else:
                    asked.append(word)
        for a in range(0, len(asked), LEARNED):
            some = asked[a:a + LEARNED]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                words[word] = tuple(found.ids)
        ids, starts, costs = self.ids, self.starts, self.costs
        for word, marks in parts:
            ids.extend(words[word])
            ids.extend(words[marks])
            starts.append(len(ids))
            costs.append(SENTENCE_COST if (marks or word).rstrip("\"')]")[-1:] in SENTENCE_ENDS else INNER_COST)
        self.number.new = []

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            text = text.encode().translate(LOWER).decode()
        return text.replace("\r", " ").replace("\t", " ").replace("\n", " \n ").split(" ")

    def stream(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents with their end ids; ends of the documents; cut places after pieces and their costs."""
        if len(self.number) > REMEMBERED:
            self.reset()
        split: list[str | None] = []
        for text in docs:
            split += self.split(text)
            split.append(None)
        at = np.fromiter(map(self.number.__getitem__, split), np.int64, len(split))
        self.learn()
        starts, ids = np.array(self.starts), np.array(self.ids, np.uint32)
        sizes = (starts[1:] - starts[:-1])[at]
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        costs = np.array(self.costs)[at]
        cut = costs < INNER_COST
        return ids[np.repeat(starts[at], sizes) + inside], ends[at == 2], ends[cut], costs[cut]


def places(total: int, ends: np.ndarray, costs: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """All cut places in order, from 0 to `total`, with the cheapest cost of each.

    Stretches of more than GAP ids without a place get inner ones every GAP / 2 ids. The last stream also gets places
    at sums of up to three powers of two before its end, so that its rest can be cut into unpadded lengths.
    """
    known = np.concatenate([[0], ends, [total]])
    gaps = np.flatnonzero(np.diff(known) > GAP)
    inner = [np.arange(known[g] + GAP // 2, known[g + 1], GAP // 2) for g in gaps]
    if last:
        powers = [1 << p for p in range(CAPACITY.bit_length() - 1)]
        sums = {a + b + c for a in powers for b in (0, *powers) for c in (0, *powers)}
        inner.append(total - np.array([s for s in sums if s < min(total, CAPACITY)], np.int64))
    more = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    at = np.concatenate([[0], ends, [total], more])
    cost = np.concatenate([[0], costs, [0], np.full(len(more), INNER_COST)])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    return at[first], cost[first]


def best_cuts(at: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY, last: bool = True) -> list[int]:
    """Places (numbers into `at`) where the cheapest windows end. Without `last`, the final window stays open and free.

    Unpadded windows are of SHORTEST ids at least, except at the end of the data. best[j] = cost[j] + min(over starts i within capacity of best[i] + capacity - (at[j] - at[i]),
    over starts at a power-of-two distance of best[i]); `queue` keeps starts of growing best + at.
    """
    exact: dict[int, list[int]] = {}
    for p in range(0 if last else SHORTEST.bit_length() - 1, capacity.bit_length()):
        size = 1 << p
        i = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at >= size) & (at[np.minimum(i, len(at) - 1)] == at - size)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    spot, price = at.tolist(), cost.tolist()
    best, came = [0] + [0] * (len(spot) - 1), [0] * len(spot)
    queue: deque[int] = deque([0])
    for j in range(1, len(spot)):
        here = spot[j]
        while spot[queue[0]] < here - capacity:
            queue.popleft()
        start = queue[0]
        low = best[start] + capacity - here + spot[start]
        for i in exact.get(j, ()):
            if best[i] < low:
                low, start = best[i], i
        best[j], came[j] = low + price[j], start
        level = best[j] + here
        while queue and best[queue[-1]] + spot[queue[-1]] >= level:
            queue.pop()
        queue.append(j)
    j = len(spot) - 1
    if not last:
        reach = np.searchsorted(at, at[-1] - capacity)
        j = min(range(int(reach), len(spot)), key=lambda i: (best[i], -i))
    found = []
    while j:
        found.append(j)
        j = came[j]
    return found[::-1]


class Packer:
    """Packs a stream of documents block by block; what the open last window holds is carried into the next block."""

    def __init__(self, pieces: Pieces, capacity: int, first_sequence: int):
        self.pieces, self.capacity, self.sequence = pieces, capacity, first_sequence
        self.ids, self.docs = np.zeros(0, np.uint32), []
        self.ends = self.costs = np.zeros(0, np.int64)

    def block(self, doc_ids: list, docs: list[str], last: bool = False) -> tuple[list, dict[str, np.ndarray], np.ndarray] | None:
        """doc_ids, the piece columns and the ids of all pieces in a row; None if no window is complete yet."""
        if docs:
            held = len(self.ids)
            ids, ends, cuts, costs = self.pieces.stream(docs)
            sizes = np.diff(np.concatenate([[0], ends]))
            self.docs += [(d, int(n), 0, int(n)) for d, n in zip(doc_ids, sizes)]
            self.ids = np.concatenate([self.ids, ids])
            self.ends, self.costs = np.concatenate([self.ends, cuts + held]), np.concatenate([self.costs, costs])
        if not len(self.ids):
            return None
        at, cost = places(len(self.ids), self.ends, self.costs, last)
        windows = at[np.array([0, *best_cuts(at, cost, self.capacity, last)])]
        done = int(windows[-1])
        spans = np.concatenate([[0], np.cumsum([left for *_, left in self.docs])])
        bounds = np.unique(np.concatenate([windows, spans[spans <= done]]))
        owner = np.searchsorted(spans, bounds[:-1], side="right") - 1
        window = np.searchsorted(windows, bounds[:-1], side="right") - 1
        starts = np.array([d[2] for d in self.docs])
        out = {"start": bounds[:-1] - spans[owner] + starts[owner], "length": np.diff(bounds),
               "doc_tokens": np.array([d[1] for d in self.docs])[owner], "sequence_id": window + self.sequence,
               "offset": bounds[:-1] - windows[window]} if done else None
        names, packed = [self.docs[i][0] for i in owner], self.ids[:done]
        self.sequence += len(windows) - 1
        open_doc = int(np.searchsorted(spans, done, side="right")) - 1
        rest = self.docs[open_doc:]
        if rest and done > spans[open_doc]:
            d, n, start, left = rest[0]
            gone = done - int(spans[open_doc])
            rest[0] = (d, n, start + gone, left - gone)
        self.docs, self.ids = rest, self.ids[done:].copy()
        kept = self.ends > done
        self.ends, self.costs = self.ends[kept] - done, self.costs[kept]
        return (names, out, packed) if out else None


def _edges(documents: DataFrame) -> list[int]:
    """Bounds of segments of doc_id: its approximate quantiles, so crowded stretches have many; an id that fills whole
    segments has one of its own. Without ids, one segment."""
    facts = documents.agg(F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)]).alias("marks"), F.min("doc_id").alias("low"),
                          F.max("doc_id").alias("high")).first()
    marks = Counter(int(m) for m in facts["marks"] or [])
    if facts["low"] is None:
        return [0, 1]
    return sorted({int(facts["low"]), int(facts["high"]) + 1, *marks, *(m + 1 for m, n in marks.items() if n > 1)})


def _cell(edges: list[int]) -> Column:
    """Number of the cell of a doc_id, growing with it: SPLIT equal widths in every segment. Null is cell -1."""
    groups = [edges[i:i + 32] for i in range(0, len(edges) - 1, 32)]
    whole = lambda values: F.array(*[F.lit(int(v)) for v in values])
    upto = lambda values, x: F.size(F.filter(values, lambda e: e <= x))
    x = F.col("doc_id").cast("bigint")
    group = upto(whole(g[0] for g in groups), x) - 1
    segment = group * 32 + upto(F.get(F.array(*[whole(g) for g in groups]), group), x) - 1
    low, high = (F.get(whole(edges), segment + i).cast("double") for i in (0, 1))
    inside = F.least(F.greatest(F.floor((x - low) / (high - low) * SPLIT), F.lit(0)), F.lit(SPLIT - 1))
    return F.coalesce((segment * SPLIT + inside).cast("int"), F.lit(-1))


def _ranges(documents: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """`documents` with `_range`, growing with doc_id, of about `range_bytes` of text each, and the number of ranges.

    Sizes are summed in cells of doc_id whose edges come from the data, so the table that comes to the driver and goes
    back as a broadcast has some SEGMENTS * SPLIT rows at most, and an outlying id moves no other row. A cell of a single id, or the
    cell of rows without one, is dealt over as many ranges as its bytes call for, by a hash of the text.
    """
    sized = documents.withColumn("_cell", _cell(_edges(documents)))
    sizes = sized.groupBy("_cell").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"),
                                       F.coalesce(F.min("doc_id") == F.max("doc_id"), F.lit(True)).alias("single")).orderBy("_cell").toArrow()
    cells, n, single = (sizes.column(c).to_numpy() for c in ("_cell", "n", "single"))
    ends = np.cumsum(n)
    first = (ends - n) // range_bytes
    parts = np.where(single, (ends - 1) // range_bytes - first + 1, 1) if len(n) else first
    used = np.unique(ranges_of(first, parts))
    table = documents.sparkSession.createDataFrame(pa.table({"_cell": pa.array(cells, pa.int32()), "_first": pa.array(np.searchsorted(used, first), pa.int32()),
                                                             "_parts": pa.array(parts, pa.int32())}))
    dealt = F.col("_first") + F.pmod(F.xxhash64(F.lit("range"), F.col("text")), F.col("_parts")).cast("int")
    return sized.join(F.broadcast(table), "_cell").withColumn("_range", dealt).drop("_cell", "_first", "_parts"), max(1, len(used))


def ranges_of(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] … first[i] + n[i] - 1 of all i in a row."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece.

    `tokenizer` is the path of a tokenizers file that all executors can read. Null texts count as empty: they are one
    end id. Documents go in order of doc_id, those without one first, equal ids by text; more than about `range_bytes` of
    one id go to several ranges by a hash of the text, each in order of the text. Repeated rows are packed again. A document longer than a sequence goes over several. Columns but doc_id and text are not read;
    an empty table gives an empty result. Only the last sequence of a range may be padded by the end of data.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows, number = _ranges(documents.select("doc_id", "text"), range_bytes)
    dealt = rows.repartitionById(number, F.col("_range")).sortWithinPartitions("doc_id", "text").select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(Pieces(tokenizer, end_id), capacity, TaskContext.get().partitionId() << 32)

        def emit(found, doc_type):
            names, columns, ids = found
            at = np.concatenate([[0], np.cumsum(columns["length"])]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(names, doc_type), *[pa.array(c.astype(np.int64)) for c in columns.values()], data],
                                              ["doc_id", *columns, "ids"])

        doc_type = pa.int64()
        for b in batches:
            doc_type = b.column("doc_id").type
            names, words = b.column("doc_id").to_pylist(), texts(b.column("text"))
            for first, last in groups_of(np.array([len(w) for w in words]), BLOCK_CHARS):
                found = packer.block(names[first:last], words[first:last])
                if found:
                    yield emit(found, doc_type)
        found = packer.block([], [], last=True)
        if found:
            yield emit(found, doc_type)

    return dealt.mapInArrow(pack, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
