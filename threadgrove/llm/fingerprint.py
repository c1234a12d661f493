"""Homomorphic multiset fingerprints of documents, as column expressions.

The fingerprint of a text is a sum of wide vectors, one per paragraph (line), lane by lane modulo a power of two. A
paragraph's vector has two parts. The equality part holds EQUAL lanes of hashes of the whole paragraph, modulo
2^EQUAL_BITS. The likeness part is itself a sum over the paragraph's clauses: each clause adds 0 or 1 to each of
LANES counters, modulo 2^20, three counters to a long, by the bits of its hashes. So order does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector (`add`, `subtract`), without the rest of the text.

Centred, the counters are random signs summed over clauses; the cosine of two such vectors estimates the cosine of
the two clause multisets, with a standard error of about 1 / sqrt(LANES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EQUAL = 4
EQUAL_BITS = 60
HASHES = 2
SHIFTS = 21
PACKED = 3
COUNT_BITS = 20
LANES = HASHES * SHIFTS * PACKED
ONES = 1 | 1 << 21 | 1 << 42
COUNTS = ((1 << COUNT_BITS) - 1) * ONES
CLAUSE_ENDS = r"[^\p{L}\p{N}\s]+\s*"
BLOCK_ROWS = 2000
BROADCAST_BLOCKS = 100_000


def paragraphs(text: Column) -> Column:
    """The lines of a text, empty ones too, so that equal multisets of lines are what equality means."""
    return F.split(text, "\n")


def clauses(text: Column) -> Column:
    """What lies between punctuation inside the lines, without empty clauses."""
    return F.filter(F.split(text, CLAUSE_ENDS + "|\\s*\n\\s*"), lambda c: c != "")


def bound(value: Column, use) -> Column:
    """`use(value)`, with `value` evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def _equal_lanes(lines: Column) -> list[Column]:
    whole = F.lit((1 << EQUAL_BITS) - 1)

    def lane(k: int) -> Column:
        hashed = lambda p: F.xxhash64(F.lit(k), p).bitwiseAND(whole)
        return F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, p: (a + hashed(p)).bitwiseAND(whole))

    return [lane(k) for k in range(EQUAL)]


def _counters(parts: Column, k: int) -> Column:
    """SHIFTS longs: how many clauses have a hash bit set, three bits' counters to a long."""
    shifts = F.sequence(F.lit(0), F.lit(SHIFTS - 1))
    add_bits = lambda hashes, s: F.aggregate(
        hashes, F.lit(0).cast("bigint"),
        lambda a, h: (a + F.call_function("shiftrightunsigned", h, s).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(COUNTS)))
    return bound(F.transform(parts, lambda c: F.xxhash64(F.lit(EQUAL + k), c)), lambda hashes: F.transform(shifts, lambda s: add_bits(hashes, s)))


def fingerprint(text: Column) -> Column:
    """array<bigint>: EQUAL lanes, HASHES * SHIFTS longs of counters, the number of clauses. Null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    likeness_part = bound(clauses(text), lambda parts: F.concat(
        *[_counters(parts, k) for k in range(HASHES)], F.array(F.size(parts).cast("bigint"))))
    return F.concat(bound(paragraphs(text), lambda lines: F.array(*_equal_lanes(lines))), likeness_part)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the two paragraph multisets together; `subtract` undoes it."""
    return _combined(a, b, lambda x, y, m: (x + y).bitwiseAND(m), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint after the paragraphs behind `b` are deleted from those behind `a`."""
    borrow = F.lit((1 << COUNT_BITS) * ONES)
    return _combined(a, b, lambda x, y, m: F.when(m == COUNTS, (x.bitwiseOR(borrow) - y).bitwiseAND(m)).otherwise(F.pmod(x - y, m + 1)), lambda x, y: x - y)


def _combined(a: Column, b: Column, lane, count) -> Column:
    head, tail = EQUAL, HASHES * SHIFTS
    whole, counts = F.lit((1 << EQUAL_BITS) - 1), F.lit(COUNTS)
    return F.concat(F.zip_with(F.slice(a, 1, head), F.slice(b, 1, head), lambda x, y: lane(x, y, whole)),
                    F.zip_with(F.slice(a, head + 1, tail), F.slice(b, head + 1, tail), lambda x, y: lane(x, y, counts)),
                    F.array(count(a[head + tail], b[head + tail])))


def signs(print_: Column) -> Column:
    """The counters as signed sums: clauses with the bit set minus clauses without, centred modulo 2^20."""
    n, half = print_[EQUAL + HASHES * SHIFTS], 1 << (COUNT_BITS - 1)
    count = lambda x, j: F.call_function("shiftrightunsigned", x, F.lit(j * SHIFTS)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    signed = lambda x, j: F.pmod(count(x, j) * 2 - n + half, F.lit(1 << COUNT_BITS)) - half
    return F.flatten(F.transform(F.slice(print_, EQUAL + 1, HASHES * SHIFTS), lambda x: F.array(*[signed(x, j).cast("double") for j in range(PACKED)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the estimated cosine of the clause multisets, not below 0."""
    cosine = bound(F.struct(signs(a).alias("a"), signs(b).alias("b")), lambda v: F.try_divide(
        _dot(v["a"], v["b"]), F.sqrt(_dot(v["a"], v["a"]) * _dot(v["b"], v["b"]))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def as_string(print_: Column) -> Column:
    """Sixteen hex digits per long."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _blocks(documents: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """`documents` (doc_id, text) with `_block`, growing with doc_id, of about `rows` rows each, and the number of blocks.

    64 approximate quantiles bound the coarse ranges; each is cut into equal widths. Rows without an id go to blocks
    below all others, by text hash. The result of the operator does not depend on where the cuts are.
    """
    facts = documents.agg(F.percentile_approx("doc_id", [i / 64 for i in range(65)]).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    cuts = sorted(set(facts["cuts"] or [0]))
    cuts.append(cuts[-1] + 1)
    fine = max(1, -(-facts["n"] // (rows * (len(cuts) - 1))))
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    coarse = F.least(F.greatest(F.size(F.filter(F.lit(bounds), lambda c: c <= F.col("doc_id"))), F.lit(1)), F.lit(len(cuts) - 1))
    low, high = F.element_at(bounds, F.col("_coarse")), F.element_at(bounds, F.col("_coarse") + 1)
    inside = F.least(F.greatest(F.floor((F.col("doc_id") - low) / (high - low) * fine), F.lit(0)), F.lit(fine - 1))
    unnamed = -1 - F.shiftright((F.shiftright(F.col("_hash"), 48) + 32768) * fine, 16)
    out = documents.withColumn("_hash", F.xxhash64("text")).withColumn("_coarse", coarse)
    block = F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.col("_coarse") * fine + inside).cast("bigint")
    return out.withColumn("_block", block).drop("_coarse"), fine * len(cuts)


def with_next(documents: DataFrame, carried: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """`documents` (doc_id, text, …) with `next`: a struct of the `carried` columns of the next row.

    Next means next in descending doc_id (rows without an id last; equal ids by text hash, then text); after the
    last row comes the first. The texts are shuffled once, by block: every block also gets a copy of the row that opens the
    next block, so no order runs through one task.
    """
    blocked, count = _blocks(documents, rows)
    key = F.struct((-F.col("doc_id")).alias("down"), "_hash")
    heads = blocked.select("_block", F.col("doc_id").alias("_id"), F.col("_hash").alias("_x"), key.alias("_key")).groupBy("_block").agg(
        F.min_by(F.struct("_id", "_x"), "_key").alias("_head"))
    order = Window.orderBy(F.desc("_block"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asks = heads.select("_block", F.col("_head._id").alias("_id"), F.col("_head._x").alias("_x"), F.coalesce(
        F.lag("_block").over(order), F.last("_block").over(everything)).alias("_to"))
    asks = F.broadcast(asks) if count <= BROADCAST_BLOCKS else asks
    asks = asks.withColumnRenamed("_block", "_from")
    copies = blocked.join(asks, (F.col("_block") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_x")))
    copies = copies.select(*documents.columns, "_hash", F.col("_to").alias("_block"), F.lit(1).alias("_copy"))
    dealt = blocked.withColumn("_copy", F.lit(0)).select(*copies.columns).unionAll(copies)
    inside = Window.partitionBy("_block").orderBy("_copy", F.desc_nulls_last("doc_id"), "_hash", "text")
    ahead = F.lead(F.struct(*carried)).over(inside)
    return dealt.withColumn("next", ahead).filter(F.col("_copy") == 0).select(*documents.columns, "next")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text replaces the last floor(n_chars / 3) code points by as many first ones of the next row's text (or
    all it has). Null texts count as empty; a table of one row has itself as next; an empty table gives an empty
    result; repeated rows are rows of their own. Two texts without clauses are alike only if their fingerprints are equal.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", fingerprint(F.col("text")))
    pairs = with_next(rows, ["text", "print"]).withColumn("n_chars", F.length("text").cast("bigint"))
    moved = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - moved), F.substring(F.col("next.text"), F.lit(1), moved))
    edited_rows = pairs.withColumn("edited", edited).withColumn("edited_print", fingerprint(F.col("edited")))
    return edited_rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_string(F.col("print")).alias("fingerprint"),
        as_string(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next.print")).alias("near_next"))
