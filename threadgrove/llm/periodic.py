"""Runs of repeated words in documents, by an online dynamic program over sparse diagonals.

A diagonal is a lag: the word at i matches its earlier occurrence at i - lag. Words are read once, in order; every open
diagonal grows by one match or ends, and one that ends after enough matches is a run, emitted at once. A diagonal that
can become a run matches at least 3 * lag words in a row, so at three multiples of its lag. Hence an earlier occurrence
opens its diagonal only at a multiple of the lag where the next two multiples match as well. Over all lags these places
number n ln n, however frequent a word is, and nearly all of them fail in one array comparison; no run is lost.
A lag that is a multiple of the lag of an open run reaching back as far finds the same stretch, and is not opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS = 6
PERIODS = 4
BLOCK = 1 << 15
TABLE_WORDS = 2048

Run = tuple[int, int, int]


def places(first: int, last: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, lag) with i a multiple of lag, first <= i < last and lag <= longest, lags in order."""
    lags = np.arange(1, longest + 1)
    start = np.maximum(-(-first // lags), 1) * lags
    n = np.maximum(-(-(last - start) // lags), 0)
    lag = np.repeat(lags, n)
    return np.repeat(start, n) + lag * (np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)), lag


class Places:
    """The places of short documents, computed once; those of longer ones in blocks of words, so memory is bounded."""

    def __init__(self):
        i, lag = places(0, TABLE_WORDS, TABLE_WORDS // PERIODS)
        order = np.argsort(i, kind="stable")
        self.i, self.lag = i[order], lag[order]

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n <= TABLE_WORDS:
            m = int(np.searchsorted(self.i, n))
            yield self.i[:m], self.lag[:m]
            return
        step = max(BLOCK, n // 32)
        for first in range(0, n, step):
            yield places(first, min(first + step, n), n // PERIODS)


def openings(w: np.ndarray, table: Places) -> Iterator[tuple[int, int]]:
    """(i, lag) in order of i, then lag, where a diagonal may open."""
    n = len(w)
    for i, lag in table.of(n):
        may = i + 2 * lag < n
        i, lag = i[may], lag[may]
        for k in range(3):
            same = w[i + k * lag] == w[i + (k - 1) * lag]
            i, lag = i[same], lag[same]
        order = np.lexsort((lag, i))
        yield from zip(i[order].tolist(), lag[order].tolist())


def find_runs(w: np.ndarray, table: Places) -> list[Run]:
    """(start, length, period) of all runs over word numbers `w`, by start, then period."""
    found: list[Run] = []
    words = None
    since: dict[int, int] = {}  # lag -> first matching word of its open diagonal
    at = 0

    def close(lag: int, end: int) -> None:
        start = since.pop(lag) - lag
        if end - start >= max(LEAST_WORDS, PERIODS * lag):
            found.append((start, end - start, lag))

    def read(until: int) -> None:
        """Words at … until - 1 go through the open diagonals."""
        nonlocal at
        while since and at < until:
            for lag in [lag for lag in since if words[at] != words[at - lag]]:
                close(lag, at)
            at += 1
        at = max(at, until)

    for i, lag in openings(w, table):
        if words is None:
            words = w.tolist()
        read(i + 1)
        if lag in since or any(lag % q == 0 and since[q] - q <= i - lag for q in since):
            continue
        first = i
        while first > lag and words[first - 1] == words[first - 1 - lag]:
            first -= 1
        since[lag] = first
    read(len(w))
    for lag in list(since):
        close(lag, len(w))
    return sorted(found, key=itemgetter(0, 2))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run covers after its first period."""
    if not runs:
        return words
    kept, end = [], 0
    for first, last in sorted((s + q, s + n) for s, n, q in runs):
        kept += words[end:max(first, end)]
        end = max(end, last)
    return kept + words[end:]


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed (text) for every row.

    Words are what lies between ASCII blanks, whole texts are read. A run is a stretch of words with smallest period q and
    length of at least max(6, 4 q) that no neighbouring word extends. `collapsed` has the words that no run covers after
    its first period, joined by one space. Null and empty texts have no words, so no runs. Rows are treated one
    by one: repeated rows, null ids and extra columns do not matter; an empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Places()
        for b in batches:
            runs, kept = [], []
            for text in b.column("text").to_pylist():
                words = (text or "").encode().split()
                known: dict[bytes, int] = {}
                w = np.fromiter((known.setdefault(x, len(known)) for x in words), np.int32, len(words))
                # a run repeats words, so a text of distinct words has none
                found = find_runs(w, table) if len(words) >= LEAST_WORDS and len(known) < len(words) else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(b" ".join(collapsed(words, found)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, kind), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        find, f"doc_id {doc_id}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
