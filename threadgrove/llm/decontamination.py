"""Benchmark decontamination: a prefix-filtered set join of item windows and documents, as column expressions.

An item's windows are its stretches of WINDOW words; a shorter item is one window. A window is contained in a document
where all its words follow each other there, so all its shingles occur and one necessary token, its prefix, is enough to
find it: of the window's shingles the one that is rarest in all documents. The steps:

1. Documents are read once: places where an item shingle may stand are stored with the words around them.
2. Occurrences of all item shingles are counted over these places. A window with a shingle that no document has is dropped; the
   places meet the remaining windows on their prefix tokens only.
3. Length and positional bounds: the token's place in the window fixes where the window would start and end, which must
   lie inside the document.
4. The words at that place are compared with the window's, word by word.

Before a shuffle or join, each task keeps only the positions whose shingle hash hits a bitmap of the tokens asked for (at most
2^MOST_BITS bits), with the few words around them, so what leaves the scan follows the overlap with the
items, not the text. Where such stretches would hold more words than the text, its words are stored once. Neither documents nor items go through the driver; the bitmap does.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.llm.fingerprint import bound
from threadgrove.session import stored

WINDOW = 10
SHINGLE = 4
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_BITS, MOST_BITS, BITS_A_TOKEN = 16, 24, 256


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters; A-Z become lower case, other letters stay. Null has none."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lower, BETWEEN), ""), F.array().cast("array<string>"))


def starts(size: Column, width: int | Column) -> Column:
    """0 … size - width, empty if there is no room."""
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def shingle(of: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(of, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item (id as string), window (array of words), for each distinct window of each item."""
    rows = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    size = F.size("w")
    cut = F.transform(starts(size, F.least(size, F.lit(window))), lambda i: F.slice("w", i + 1, F.lit(window)))
    return rows.filter(size > 0).select("item", F.explode(cut).alias("window")).distinct()


def tokens(windows: DataFrame) -> DataFrame:
    """window, offset, size, token: the shingles of each window; those of windows shorter than a shingle have its size."""
    n = F.size("window")
    by_size = [F.when(n == k, F.array(F.struct(F.lit(0).alias("offset"), F.lit(k).alias("size"), shingle(F.col("window"), F.lit(0), k).alias("token"))))
               for k in range(1, SHINGLE)]
    whole = F.transform(starts(n, SHINGLE), lambda i: F.struct(i.alias("offset"), F.lit(SHINGLE).alias("size"), shingle(F.col("window"), i, SHINGLE).alias("token")))
    return windows.select("window", F.inline(F.coalesce(*by_size, whole)))


class Bitmap:
    """Which hashes may be among the tokens of a table: one bit for each value of the low bits of a hash."""

    def __init__(self, table: DataFrame):
        n = table.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, (n * BITS_A_TOKEN).bit_length()))
        slot = F.col("token").bitwiseAND(F.lit((1 << self.bits) - 1))
        set_bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int")))
        held = dict(map(tuple, table.groupBy(F.shiftright(slot, 6).alias("at")).agg(set_bits).collect()))
        self.sizes = sorted(r[0] for r in table.select("size").distinct().collect())
        self.longs = F.from_json(F.lit(str([held.get(i, 0) for i in range(1 << self.bits - 6)])), "array<bigint>")

    def has(self, hashed: Column) -> Column:
        slot = hashed.bitwiseAND(F.lit((1 << self.bits) - 1))
        return F.getbit(F.get(self.longs, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    def hits(self, of: Column, size: int) -> Column:
        """(at, token) of every position whose shingle of `size` words may be a token."""
        hashes = F.transform(starts(F.size(of), size), lambda i: shingle(of, i, size))
        return F.array_compact(F.transform(hashes, lambda h, i: F.when(self.has(h), F.struct(i.alias("at"), h.alias("token")))))


def around(of: Column, place: Column, size: Column, context: int) -> tuple[Column, Column]:
    """The first word of a stretch with `context` words on either side of a shingle, and the words of the stretch."""
    first = F.greatest(F.lit(0), place - context)
    return first, F.slice(of, first + 1, place - first + size + context)


def hits(documents: DataFrame, item_tokens: DataFrame, context: int) -> DataFrame:
    """doc_id, row (a number for every row), n_words, hits (array of at, token, size, words), words, in one scan of the texts.

    A hit is a place whose shingle may be one of `item_tokens`; its words are those around it. Of a row whose hits would hold more words
    than its text, `words` are all words and hits have none.
    """
    kind = "array<struct<at:int,token:bigint,size:int,words:array<string>>>"
    bitmap = Bitmap(item_tokens)

    def sized(k: int):
        return lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"), F.lit(k).alias("size"))

    def found(w: Column) -> Column:
        places = [F.transform(bitmap.hits(w, k), sized(k)) for k in bitmap.sizes]
        return bound(F.concat(F.array().cast("array<struct<at:int,token:bigint,size:int>>"), *places), lambda h: stretches(w, h))

    def stretches(w: Column, h: Column) -> Column:
        dense = F.size(h) * (2 * context + max(bitmap.sizes, default=0)) > F.size(w)
        held = F.transform(h, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"), x["size"].alias("size"),
                                                 F.when(~dense, around(w, x["at"], x["size"], context)[1]).alias("words")))
        return F.struct(F.size(w).alias("n_words"), held.cast(kind).alias("hits"), F.when(dense, w).alias("words"))

    rows = documents.select("doc_id", bound(words(F.col("text")), found).alias("x"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "x.n_words", "x.hits", "x.words")


def token_counts(found: DataFrame, item_tokens: DataFrame) -> DataFrame:
    """token, n: how often each token is among the hits; tokens that never are are left out."""
    counts = found.select(F.explode("hits.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(item_tokens.select("token").distinct(), "token", "left_semi")


def occurrence_counts(texts: DataFrame, item_tokens: DataFrame) -> DataFrame:
    """token, n: how often each token occurs in all texts; tokens that never occur are left out."""
    return token_counts(hits(texts, item_tokens, 0), item_tokens)


def prefixes(item_tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """The rarest token of each window all of whose tokens occur; ties go to the smaller hash, then offset."""
    known = item_tokens.join(counts, "token", "left")
    best = known.groupBy("window").agg(F.min(F.struct("n", "token", "offset", "size")).alias("p"), F.count("n").alias("seen"), F.count(F.lit(1)).alias("all"))
    return best.filter(F.col("seen") == F.col("all")).select("window", "p.token", "p.offset", "p.size")


def contained(occurrences: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, window, start, length: windows whose words stand in the row, `start` counted in words from 0."""
    start = F.col("at") - F.col("offset")
    length = F.size("window")
    met = occurrences.join(prefix, ["token", "size"]).filter((start >= 0) & (start + length <= F.col("n_words")))
    return met.filter(F.slice("words", start - F.col("first") + 1, length) == F.col("window")).select(
        "row", "window", start.alias("start"), length.alias("length"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (array of start, length in words, by start: all places of item windows, the longest of each
    start), n_hit (words in any of them), items (ids as sorted strings) for every row of `documents`.

    A row with null or empty text has no words. Items without an id or without words have no windows; rows with one item
    id are one item. Repeated documents each get their row, null doc_ids too; extra columns are not read. Without
    documents the result is empty, without items nothing is hit.
    """
    items = stored(item_windows(benchmark, window))
    item_tokens = stored(tokens(items.select("window").distinct()))
    context = window - item_tokens.agg(F.coalesce(F.min("size"), F.lit(window))).first()[0]
    kept = stored(hits(documents, item_tokens, context))
    prefix = stored(prefixes(item_tokens, token_counts(kept, item_tokens)))
    asked = Bitmap(prefix)
    met = kept.select("row", "n_words", "words", F.explode(F.filter("hits", lambda x: asked.has(x["token"]))).alias("x"))
    first, whole = around(F.col("words"), F.col("x.at"), F.col("x.size"), context)
    places = stored(contained(met.select("row", "n_words", "x.at", "x.token", "x.size", first.alias("first"), F.coalesce("x.words", whole).alias("words")), prefix))
    longest = places.groupBy("row", "start").agg(F.max("length").alias("length"))
    # one list per row, as long as its text at most
    spans = longest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    named = places.select("row", "window").distinct().join(items, "window").select("row", "item").distinct()
    ids = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    end = lambda x: x["start"] + x["length"]
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), end(x) - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], end(x)).alias("end")), lambda a: a["n"])
    out = kept.select("row", "doc_id", "n_words").join(spans, "row", "left").join(ids, "row", "left")
    return out.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"),
                      F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
                      F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
