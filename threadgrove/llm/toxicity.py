"""Toxicity by the nearest labelled examples under exact cosine, found in a block-max inverted index.

Terms are whole words and word beginnings of 4 and 5 letters. TF-IDF vectors are taken over all terms of the
examples; the idf of a term is multiplied by its clearness (`clearness`), at least 1, so no term is without weight.
The index keeps sparse postings by term and block of 256 examples, with the largest weight of each such cell. What
the commonest terms (`COMMON`, at most) add to the cosines is one matrix product for a batch of documents; with the
maxima of the other terms it bounds each block, and a document visits the blocks whose bound reaches its k-th best
cosine so far, so the k nearest are exact.

The nearest vote with their squared cosine; the votes of a label are divided by its share of the examples, so the log of
toxic over clean votes, the margin, does not depend on how many documents an example stands for. Two numbers fitted on
the margins of the examples themselves, each without its own vote and weighted to the true sizes of the labels, turn
margins into scores. The examples are a bounded sample (`SAMPLE`, up to half of it from either label); prior and idf
follow the true sizes too. Every document is scored whole.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadgrove.llm.common import crc_rest, groups_of, labelled_sample, texts

SAMPLE = 4096
BLOCK = 256
COMMON = 1024
BATCH = 128
POSTINGS_HELD = 1 << 19  # postings, and characters below, that a batch is worked on at once; a larger text is worked on alone
CHARS_HELD = 1 << 20
NEAREST = 16
LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n))


def term_counts(text: str) -> Counter:
    """How often each term is in the text."""
    out: Counter = Counter()
    for word, n in Counter(LETTERS.findall(text.lower())).items():
        for term in word_terms(word):
            out[term] += n
    return out


def clearness(a: np.ndarray, b: np.ndarray, n1: int, n0: int, smooth: float = 0.5) -> np.ndarray:
    """By how many standard errors the log odds of terms in `a` of `n1` toxic and `b` of `n0` clean examples are from 0."""
    a, b, n1, n0 = a + smooth, b + smooth, n1 + 2 * smooth, n0 + 2 * smooth
    odds = np.log(a / (n1 - a)) - np.log(b / (n0 - b))
    return np.abs(odds) / np.sqrt(1 / a + 1 / b + 1 / (n1 - a) + 1 / (n0 - b))


class Counted:
    """Terms of examples as numbers: example i has the terms term[ends[i]] … term[ends[i + 1] - 1], `times` as often.
    A term is held once, not once per example."""

    def __init__(self, rows: Iterable[Counter] = ()):
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.term, self.times, self.ends = array("i"), array("i"), array("q", [0])
        for r in rows:
            self.add(r)

    def add(self, row: Counter) -> None:
        self.term.extend(map(self.number.__getitem__, row))
        self.times.extend(row.values())
        self.ends.append(len(self.term))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Examples, terms and times, by example."""
        owner = np.repeat(np.arange(len(self.ends) - 1, dtype=np.int32), np.diff(self.ends))
        return owner, np.array(self.term, np.int32), np.array(self.times, np.int32)


def clear_terms(rows: Counted, y: np.ndarray) -> list[str]:
    """All terms of the examples, the clearest first."""
    owner, term, _ = rows.arrays()
    terms = sorted(rows.number)
    at = np.array([rows.number[t] for t in terms], np.int64)
    a, b = (np.bincount(term[y[owner] == c], minlength=len(terms))[at].astype(float) for c in (1, 0))
    z = clearness(a, b, int(y.sum()), int(len(y) - y.sum()))
    return [terms[i] for i in np.argsort(-z, kind="stable")]


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first[i] … last[i] - 1, one after the other, and the sizes of the ranges."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n), n


@dataclass
class Examples:
    """What an index is made of. Term t has the next `size[t]` postings: at `place`, `times` times. Labels, ids and the
    number of labelled documents an example stands for (1 on average) are by place. `seen` are the toxic and the clean
    examples, those without a term included, `of` what one of either stands for. A score is the logistic function of
    slope * margin + offset; texts without a term get `plain`, all texts `prior` if there are no terms."""

    terms: list[str]
    size: np.ndarray
    place: np.ndarray
    times: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    stands_for: np.ndarray
    seen: tuple[int, int]
    of: tuple[float, float]
    prior: float
    plain: float
    slope: float = 1.0
    offset: float = 0.0


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers, not negative, in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


class Index:
    """Cell c, a term in a block, has postings cells[c] … cells[c + 1] - 1 and the largest weight largest[c]; term t has
    cells cells_of[t] … cells_of[t + 1] - 1."""

    def __init__(self, examples: Examples):
        self.examples = e = examples
        self.terms = {t: i for i, t in enumerate(e.terms)}
        self.labels, self.ids, self.prior, self.plain = e.labels, e.ids, e.prior, e.plain
        self.places, self.blocks = len(e.ids), max(1, -(-len(e.ids) // BLOCK))
        term, place = np.repeat(np.arange(len(e.terms), dtype=np.int32), e.size), e.place.astype(np.int32)
        a, b = (np.bincount(term[e.labels[place] == c], minlength=len(e.terms)).astype(float) for c in (1, 0))
        idf = np.log((sum(e.seen) + 1) / (a * e.of[0] + b * e.of[1] + 1)) + 1
        self.scale = idf * np.maximum(1.0, clearness(a, b, *e.seen))
        square, self.place, self.weight = np.zeros(self.places), place, np.zeros(len(term), np.float32)
        parts = [slice(i, i + POSTINGS_HELD) for i in range(0, len(term), POSTINGS_HELD)]
        weight = lambda s: (1 + np.log(e.times[s].astype(float))) * self.scale[term[s]]
        for s in parts:
            np.add.at(square, place[s], weight(s) ** 2)
        for s in parts:
            self.weight[s] = weight(s) / np.sqrt(square)[place[s]]
        block = place // BLOCK
        first = np.flatnonzero(np.append(np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
        self.block = block[first]
        self.cells, self.cells_of = np.append(first, len(term)).astype(np.int32), np.searchsorted(term[first], np.arange(len(e.terms) + 1, dtype=np.int32)).astype(np.int32)
        self.largest = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        chosen = np.argsort(-e.size.astype(np.int64), kind="stable")[:COMMON]
        self.row = np.full(len(e.terms), -1)
        self.row[chosen] = np.arange(len(chosen))
        self.matrix = np.zeros((len(chosen), self.places), np.float32)
        common = self.row[term] >= 0
        self.matrix[self.row[term[common]], place[common]] = self.weight[common]

    def weigh(self, owner: np.ndarray, at: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n documents: the weights of terms `at` that document `owner` holds so many times."""
        v = (1 + np.log(times)) * self.scale[at]
        return v / np.sqrt(np.bincount(owner, v ** 2, n))[owner]

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and the unit vector over them."""
        at = np.array(sorted(counts), np.int64)
        return at, self.weigh(np.zeros(len(at), np.int64), at, np.array([counts[t] for t in at.tolist()], float), 1)

    def all_nearest(self, owner: np.ndarray, at: np.ndarray, v: np.ndarray, n: int, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n documents, given as in `weigh`, the k examples with the largest cosine (ties to the earlier example),
        cosines above 0 only: documents, ascending, cosines, descending, and places."""
        if not self.places:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        kth = lambda c: np.partition(c, -k, axis=1)[:, -k] if self.places > k else np.zeros(len(c))
        row = self.row[at]
        common, left = row >= 0, np.zeros((n, len(self.matrix)), np.float32)
        left[owner[common], row[common]] = v[common]
        cosines = left @ self.matrix
        at, v, owner = at[~common], v[~common].astype(np.float32), owner[~common]
        order = np.argsort(owner, kind="stable")
        at, v, owner = at[order], v[order], owner[order]
        postings = np.bincount(owner, self.examples.size[at], n)
        for first, last in groups_of(postings, POSTINGS_HELD) if len(at) else ():
            a, b = np.searchsorted(owner, [first, last])
            self.add_rare(cosines[first:last], owner[a:b] - first, at[a:b], v[a:b], kth)
        doc, place = np.nonzero((cosines > 0) & (cosines >= kth(cosines)[:, None]))
        c = cosines[doc, place].astype(float)
        order = np.lexsort((place, -c, doc))
        doc, c, place = doc[order], c[order], place[order]
        first = np.arange(len(doc)) - np.searchsorted(doc, doc) < k
        return doc[first], c[first], place[first]

    def add_rare(self, cosines: np.ndarray, owner: np.ndarray, at: np.ndarray, v: np.ndarray, kth: Callable) -> None:
        """Adds to the cosines of some documents what their terms `at` with weights `v` give, in the blocks that can reach the k best."""
        n = len(cosines)
        cell, m = ranges(self.cells_of[at], self.cells_of[at + 1])
        if not len(cell):
            return
        v, owner = np.repeat(v, m), np.repeat(owner, m)
        block = owner * self.blocks + self.block[cell]
        bounds = np.bincount(block, v * self.largest[cell], n * self.blocks).reshape(n, self.blocks)
        bounds += np.maximum.reduceat(cosines, np.arange(0, self.places, BLOCK), axis=1)
        used = (bounds >= kth(cosines)[:, None] - 1e-5).ravel()[block]
        cell, v, owner = cell[used], v[used], owner[used]
        posting, m = ranges(self.cells[cell], self.cells[cell + 1])
        spot = np.repeat(owner * self.places, m) + self.place[posting]
        cosines += np.bincount(spot, np.repeat(v, m) * self.weight[posting], n * self.places).reshape(n, self.places)

    def nearest(self, at: np.ndarray, v: np.ndarray, k: int = NEAREST) -> list[tuple[float, int]]:
        _, c, place = self.all_nearest(np.zeros(len(at), np.int64), at, v, 1, k)
        return list(zip(c.tolist(), place.tolist()))

    def margins(self, doc: np.ndarray, c: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Log of toxic over clean votes of n documents; a document none votes for has 0."""
        share = self.labels.mean() if self.places else 0.5
        toxic, clean = (np.bincount(doc, c * c * (self.labels[place] == y), n) / max(s, 1e-9) for y, s in ((1, share), (0, 1 - share)))
        least = (toxic + clean) / (2 * NEAREST) + 1e-12
        return np.log((toxic + least) / (clean + least))

    def scores(self, owner: np.ndarray, at: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of n documents, given as in `weigh`, and their nearest: documents, ascending, and ids."""
        if not len(self.terms):
            return np.full(n, self.prior), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, c, place = self.all_nearest(owner, at, self.weigh(owner, at, times, n), n)
        s = 1 / (1 + np.exp(-np.clip(self.examples.slope * self.margins(doc, c, place, n) + self.examples.offset, -30, 30)))
        return np.where(np.bincount(owner, minlength=n) > 0, s, self.plain), doc, self.ids[place]

    def own_margins(self) -> np.ndarray:
        """The margin of every example by the others."""
        e = self.examples
        order = np.argsort(e.place, kind="stable").astype(np.int32)
        term, times = np.repeat(np.arange(len(e.terms), dtype=np.int32), e.size)[order], e.times[order]
        owner, ends = e.place[order], np.append(0, np.cumsum(np.bincount(e.place, minlength=self.places)))
        out = [np.zeros(0)]
        for start in range(0, self.places, BATCH):
            n = min(BATCH, self.places - start)
            a, b = ends[[start, start + n]]
            mine = owner[a:b].astype(np.int64) - start
            doc, c, place = self.all_nearest(mine, term[a:b], self.weigh(mine, term[a:b], times[a:b].astype(float), n), n, NEAREST + 1)
            other = place != doc + start
            doc, c, place = doc[other], c[other], place[other]
            other = np.arange(len(doc)) - np.searchsorted(doc, doc) < NEAREST
            out.append(self.margins(doc[other], c[other], place[other], n))
        return np.concatenate(out)


def calibration(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> tuple[float, float]:
    """Slope, above 0, and offset of the weighted logistic regression of labels on margins, by damped Newton steps."""
    x, held = np.stack([margins, np.ones(len(margins))], 1), np.array([ridge, 0.0])
    loss = lambda w: float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)) + held @ (w - start) ** 2 / 2)
    start = w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + held * (w - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-9), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def build(ids: list[int], rows: list[Counter] | Counted, y: np.ndarray, stands_for: np.ndarray | None = None) -> Index:
    """The index over examples in the order given, each of which stands for so many labelled ones, 1 if not given. One class or no example gives no terms, so the prior for all."""
    rows = rows if isinstance(rows, Counted) else Counted(rows)
    chosen = clear_terms(rows, y) if len(y) and 0 < y.sum() < len(y) else []
    number = {t: i for i, t in enumerate(chosen)}
    owner, term, times = rows.arrays()
    term = np.array([number.get(t, -1) for t in rows.number], np.int32)[term]
    held = term >= 0
    owner, term, times = owner[held], term[held], times[held]
    n = np.ones(len(y)) if stands_for is None or not len(y) else stands_for * len(y) / stands_for.sum()
    prior = float((n @ y + 0.5) / (len(y) + 1))
    blank = np.bincount(owner, minlength=len(y)) == 0
    plain = float((n[blank] @ y[blank] + prior) / (n[blank].sum() + 1)) if len(y) else prior
    used = np.flatnonzero(~blank)
    place = narrow(np.cumsum(~blank) - 1 if len(used) else np.zeros(len(y), int))[owner]
    size, order = narrow(np.bincount(term, minlength=len(chosen))), np.argsort(term, kind="stable")
    del owner, term, held, number
    examples = Examples(chosen, size, place[order], narrow(times[order]), y[used].astype(float),
                        np.array([ids[i] for i in used.tolist()], np.int64), n[used], (int(y.sum()), int(len(y) - y.sum())),
                        tuple(n[y == c].mean() if (y == c).any() else 0.0 for c in (1, 0)), prior, plain)
    del place, times, order
    index = Index(examples)
    if 0 < index.labels.sum() < len(used):
        examples.slope, examples.offset = calibration(index.own_margins(), index.labels, examples.stands_for)
    return index


@dataclass
class PackedIndex:
    """The examples of an index as compressed bytes: the driver passes these on, tasks make the index once."""

    data: bytes

    @classmethod
    def of(cls, index: Index) -> PackedIndex:
        held = {f.name: getattr(index.examples, f.name) for f in fields(Examples)}
        return cls(zlib.compress(pickle.dumps(held | {"terms": "\n".join(held["terms"])}), 6))

    def open(self) -> Index:
        held = pickle.loads(zlib.decompress(self.data))
        return Index(Examples(**held | {"terms": held["terms"].split("\n") if held["terms"] else []}))

    def __getattr__(self, name: str):
        """Parts of the index, for a look at it; opens it each time."""
        if name.startswith("_") or name == "data":
            raise AttributeError(name)
        return getattr(self.open(), name)


def train(sample: DataFrame) -> PackedIndex:
    """The index from a bounded sample. The sample's term counts are small: they go to one task, the index to all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, stands_for, rows = [], [], [], Counted()
        for b in batches:
            for part in slices(b):
                for text in texts(part.column("text")):
                    rows.add(term_counts(text))
                for held, name in ((ids, "doc_id"), (y, "label"), (stands_for, "weight")):
                    held += part.column(name).to_pylist()
        index = build(ids, rows, np.array([int(label == 1) for label in y]), np.array(stands_for))
        yield pa.RecordBatch.from_arrays([pa.array([PackedIndex.of(index).data], pa.binary())], ["index"])

    row = sample.select("doc_id", "text", "label", "weight").repartition(1).sortWithinPartitions("doc_id").mapInArrow(count, "index binary").first()
    return PackedIndex(bytes(row[0])) if row else PackedIndex.of(build([], [], np.zeros(0, int)))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, BATCH at a time, so that few texts are Python strings at once."""
    return (batch.slice(start, BATCH) for start in range(0, batch.num_rows, BATCH))


class Numbers(dict):
    """Numbers for pieces in the order in which they come up; `new` lists those not looked at yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Scorer:
    """Scores texts and remembers the examples' terms in their white-space-free, lower-case pieces."""

    REMEMBERED = 250_000

    def __init__(self, index: Index | PackedIndex):
        self.index = index.open() if isinstance(index, PackedIndex) else index
        self.reset()

    def reset(self) -> None:
        self.number, self.held, self.ends = Numbers(), array("i"), array("q", [0])

    def counts(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, ascending, their terms, ascending, and how often they hold them."""
        parts = [(first, self.part(batch[first:last])) for first, last in groups_of(np.array([len(t) for t in batch]), CHARS_HELD)]
        return (np.concatenate([np.zeros(0, np.int64), *[first + p[0] for first, p in parts]]),
                np.concatenate([np.zeros(0, np.int64), *[p[1] for _, p in parts]]), np.concatenate([np.zeros(0), *[p[2] for _, p in parts]]))

    def part(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `counts`, for texts that are worked on at once."""
        if len(self.number) > self.REMEMBERED:
            self.reset()
        split = [text.lower().split() for text in batch]
        sizes = [len(s) for s in split]
        at = np.fromiter((n for s in split for n in map(self.number.__getitem__, s)), np.int64, sum(sizes))
        known = self.index.terms
        for piece in self.number.new:
            self.held.extend([known[t] for word in LETTERS.findall(piece) for t in word_terms(word) if t in known])
            self.ends.append(len(self.held))
        self.number.new = []
        held, ends = np.array(self.held, np.int64), np.array(self.ends)
        spot, n = ranges(ends[at], ends[at + 1])
        key, times = np.unique(np.repeat(np.repeat(np.arange(len(batch)), sizes), n) * max(1, len(known)) + held[spot], return_counts=True)
        return key // max(1, len(known)), key % max(1, len(known)), times.astype(float)

    def __call__(self, texts: list[str]) -> Iterator[tuple[float, np.ndarray]]:
        """Score and ids of the nearest examples of each text."""
        for start in range(0, len(texts), BATCH):
            batch = texts[start:start + BATCH]
            scores, doc, ids = self.index.scores(*self.counts(batch), len(batch))
            yield from zip(scores.tolist(), np.split(ids, np.searchsorted(doc, np.arange(1, len(batch)))))


def toxicity_index(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PackedIndex:
    """Learns from `labels.toxic` of documents whose crc32 rest modulo 4 is not 2."""
    return train(labelled_sample(documents, labels, "toxic", crc_rest(4) != 2, sample, "toxic"))


def score_toxicity(documents: DataFrame, index: Index | PackedIndex, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) for every row of `documents`.

    Only the text is an input. A text without a term of the examples, so also a null or empty one, gets the share of
    toxic examples among such texts. Rows are scored one by one, so repeated rows, null ids and extra columns do not
    matter; an empty table gives an empty result.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(index)
        for b in (part for batch in batches for part in slices(batch)):
            found = list(of(texts(b.column("text"))))
            s = np.array([f[0] for f in found], float)
            near = pa.array([f[1] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), near],
                ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = documents.select("doc_id", (crc_rest(4) == 2).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<bigint>")


def reject_toxic(documents: DataFrame, index: Index | PackedIndex, threshold: float = 0.3) -> DataFrame:
    """The rows of `documents`, all columns, whose score is below `threshold`. The text column is named text.

    Null and empty texts score as in `score_toxicity`. Rows are judged one by one: repeated rows stay or go together,
    null ids and further columns are kept, an empty table gives an empty result.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(index)
        for b in (part for batch in batches for part in slices(batch)):
            yield b.filter(pa.array([s < threshold for s, _ in of(texts(b.column("text")))], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
