"""Language of a text from language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in every slot, one bit per language. Looking up an n-gram ands its slots: the
result is the mask of all languages that contain it. Per language, the n-grams with its bit are counted, the
count is corrected by the filter's false-positive share for that language, and the largest count decides.
The filter is fitted on a bounded sample (`SAMPLE` documents, a share for each language) and has a fixed number of slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadgrove.llm.common import crc_rest, groups_of, stratified_sample, texts

SAMPLE = 8192
SLOT_BITS = 20
LOOKUPS = 2
N = 4
WORD_BITS = 62
PIECE = 1 << 20
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def letters(text: str | None) -> str:
    """Lower-case text with one space for every run of other characters, and around it; empty without a letter."""
    plain = f" {NOT_LETTERS.sub(' ', (text or '').lower()).strip()} "
    return plain if len(plain) > 2 and any(map(str.isalpha, plain)) else ""


def gram_hashes(plain: str) -> np.ndarray:
    """A 64-bit hash of the n-gram at every position; a text shorter than N is one n-gram."""
    x = np.frombuffer(plain.ljust(N).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = sum(x[i:len(x) - N + 1 + i] * np.uint64(KEYS[i]) for i in range(N))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((hashes >> np.uint64(i * SLOT_BITS)) & mask).astype(np.int64) for i in range(LOOKUPS)]


@dataclass
class Filters:
    """`bits[word, slot]`: masks of the languages word * WORD_BITS + 0, 1, …; `false[i]`: false-positive share."""

    languages: list[str]
    common: str
    bits: np.ndarray
    false: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Per n-gram and word, the mask of all languages that contain it."""
        at = slots(hashes)
        out = self.bits[:, at[0]]
        for s in at[1:]:
            out &= self.bits[:, s]
        return out

    def counts(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: n-grams, and per language the n-grams with its bit. Long texts go piece by piece."""
        total, hits = np.zeros(len(plain), np.int64), np.zeros((len(plain), len(self.languages)), np.int64)
        for first, last in groups_of(np.array([len(p) for p in plain]), PIECE):
            if last == first + 1 and len(plain[first]) > PIECE:
                parts = [plain[first][a:a + PIECE + N - 1] for a in range(0, len(plain[first]) - N + 1, PIECE)]
                owner = [first] * len(parts)
            else:
                owner = [i for i in range(first, last) if plain[i]]
                parts = [plain[i] for i in owner]
            hashes = [gram_hashes(p) for p in parts]
            if not hashes:
                continue
            sizes = np.array([len(h) for h in hashes])
            masks, starts = self.masks(np.concatenate(hashes)), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            np.add.at(total, owner, sizes)
            for i in range(len(self.languages)):
                has = ((masks[i // WORD_BITS] >> i % WORD_BITS) & 1).astype(np.uint8)
                np.add.at(hits[:, i], owner, np.add.reduceat(has, starts, dtype=np.int64))
        return total, hits

    def decide(self, column: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the share of the corrected counts that falls to the language, 0 if none is left."""
        plain = [letters(t) for t in column]
        total, hits = self.counts(plain)
        true = np.maximum(hits - total[:, None] * self.false, 0) / (1 - self.false)
        sums = true.sum(axis=1)
        best = true.argmax(axis=1) if self.languages else np.zeros(len(plain), np.int64)
        top = true.max(axis=1) if self.languages else sums
        score = np.divide(top, sums, out=np.zeros(len(plain)), where=sums > 0)
        names = [UNKNOWN if not p or not self.languages else self.languages[b] if s > 0 else self.common
                 for p, b, s in zip(plain, best, sums)]
        return names, np.where([bool(p) for p in plain], np.minimum(score, 1.0), 0.0)


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, docs: in how many sampled documents of a language an n-gram occurs, added up per batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), texts(b.column("text"))):
                plain = letters(text)
                parts = [gram_hashes(plain[a:a + PIECE + N - 1]) for a in range(0, max(1, len(plain) - N + 1), PIECE)] if plain else []
                of.setdefault(lang, []).append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
            for lang, grams in of.items():
                gram, docs = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(docs)], ["lang", "gram", "docs"])

    return sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def train(documents: DataFrame, sample: int = SAMPLE, least_share: float = 0.01, least_part: float = 0.25) -> Filters:
    """Filters from about `sample` documents with a language whose crc32 rest modulo 5 is not 0, up to sample / languages
    of them from each language, so rare languages are learned from as many documents as common ones.

    A language contains an n-gram if at least `least_share` of its sampled documents (and two, where it has more
    than one) hold it, and at least `least_part` of the share in the language that uses it most, so that passages
    in another language do not leak into the filter. At most 2^SLOT_BITS slots come to the driver.
    """
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_rest(5) != 0)).select("doc_id", "lang", "text")
    picked, all_sizes = stratified_sample(known, "doc_id", "lang", sample, "language")
    sizes = {r[0]: r[1] for r in picked.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Filters([], UNKNOWN, np.zeros((1, 1 << SLOT_BITS), np.int64), np.zeros(0))
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("lang")]
    of = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(sizes[n]))])[F.col("lang")]
    share = (F.col("docs") / of).alias("share")
    shares = gram_counts(picked).select("gram", "docs", number.alias("i"), of.alias("n"), share)
    most = F.max("share").over(Window.partitionBy("gram"))
    held = shares.withColumn("most", most).filter(
        (F.col("share") >= least_share) & (F.col("docs") >= F.least(F.lit(2), F.col("n"))) & (F.col("share") >= least_part * F.col("most")))
    masks = held.groupBy("gram", F.floor(F.col("i") / WORD_BITS).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, i % {WORD_BITS})")).alias("mask"))
    places = F.array(*[F.expr(f"shiftrightunsigned(gram, {i * SLOT_BITS}) & {(1 << SLOT_BITS) - 1}L") for i in range(LOOKUPS)])
    table = masks.select("word", "mask", F.explode(places).alias("slot")).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros((-(-len(names) // WORD_BITS), 1 << SLOT_BITS), np.int64)
    bits[table.column("word").to_numpy(), table.column("slot").to_numpy()] = table.column("mask").to_numpy()
    full = [((bits[i // WORD_BITS] >> i % WORD_BITS) & 1).mean() for i in range(len(names))]
    return Filters(names, max(names, key=lambda n: (all_sizes[n], n)), bits, np.minimum(np.array(full) ** LOOKUPS, 0.999))


def identify_languages(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is an input.

    A null text or one without a letter is `und` with score 0, as is every text when nothing could be learned. A text
    none of whose n-grams any filter has gets the commonest learned language with score 0. Ties go to the name
    that sorts first. Rows are decided one by one: repeated rows, null ids and further columns change nothing.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = filters.decide(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", (crc_rest(5) == 0).alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decide, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
