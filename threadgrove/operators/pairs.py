"""Training pairs from forests, negatives from other threads, and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadgrove.functions.hashing import portable_hash
from threadgrove.functions.text import MIN_LENGTH, UNKNOWN, clean_text, long_enough, text_or
from threadgrove.functions.vectors import mean_vector
from threadgrove.operators.ranking import dense_index, hash_rank, take_by_hash
from threadgrove.operators.skew import lookup
from threadgrove.session import stored


def cap(df: DataFrame, group: list[str], key: list[str], n: int | None, seed: int = 42) -> DataFrame:
    """Seeded sample of at most n rows per group; everything when n is None."""
    return df if n is None else take_by_hash(df, group, key, n, seed)


def _cleaned(nodes: DataFrame, minimum: int, stop_list) -> DataFrame:
    """Comments whose cleaned text is long enough; the text column is `_text`.

    Filter and projection are one generator, because a filter on a computed column would be pushed
    below it and clean every text twice.
    """
    once = F.filter(F.array(clean_text("content", stop_list)), lambda t: long_enough(t, minimum))
    return nodes.filter(F.col("parent_id").isNotNull()).select("*", F.explode(once).alias("_text"))


def _in_large_subtrees(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, minimum: int) -> DataFrame:
    """Nodes with `root_id` and `size` of their subtree, when it has at least `minimum` nodes."""
    large = trees.filter(F.col("size") >= minimum).select("post_id", "root_id", "size")
    member = lookup(assigned.select("post_id", "comment_id", "root_id"), large, ["post_id", "root_id"])
    return nodes.join(member, ["post_id", "comment_id"])


def parent_child_pairs(nodes: DataFrame, pruned: DataFrame, assigned: DataFrame, trees: DataFrame,
                       min_size: int = 2, min_length: int = MIN_LENGTH, per_post: int | None = None,
                       stop_list=None, seed: int = 42) -> DataFrame:
    """Kept links with a known similarity whose two cleaned texts are long enough."""
    links = pruned.filter(F.col("kept") & F.col("similarity").isNotNull()).select(
        "post_id", "parent_id", "child_id", "similarity")
    if min_size > 2:  # a kept link already has two nodes
        large = trees.filter(F.col("size") >= min_size).select("post_id", "root_id")
        member = lookup(assigned.select("post_id", F.col("comment_id").alias("child_id"), "root_id"),
                        large, ["post_id", "root_id"]).drop("root_id")
        links = links.join(member, ["post_id", "child_id"])
    # each text is needed as a child and as a parent: cleaning costs more than writing
    texts = stored(_cleaned(nodes, min_length, stop_list).select("post_id", "comment_id", "_text"))
    child = texts.select("post_id", F.col("comment_id").alias("child_id"), F.col("_text").alias("positive_content"))
    parent = texts.select("post_id", F.col("comment_id").alias("parent_id"), F.col("_text").alias("anchor_content"))
    pairs = lookup(links.join(child, ["post_id", "child_id"]), parent, ["post_id", "parent_id"], counted=links)
    pairs = cap(pairs, ["post_id"], ["post_id", "child_id"], per_post, seed)
    return pairs.select("post_id", "parent_id", "child_id", "anchor_content", "positive_content", "similarity")


def node_center_pairs(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, min_size: int = 3,
                      min_length: int = MIN_LENGTH, per_subtree: int | None = None, stop_list=None,
                      seed: int = 42) -> DataFrame:
    """One row per node: its text and the subtree whose centre it is paired with.

    The centre's texts are the rows of `center_members` with the same (post_id, root_id). They are
    not repeated inside every pair: the list would make the output quadratic in the subtree size.
    """
    rows = _in_large_subtrees(_cleaned(nodes, min_length, stop_list), assigned, trees, max(min_size, 3))
    rows = cap(rows, ["post_id", "root_id"], ["post_id", "comment_id"], per_subtree, seed)
    return rows.select("post_id", "root_id", F.col("comment_id").alias("node_id"),
                       F.col("_text").alias("anchor_content"), F.col("size").alias("subtree_size"),
                       F.lit("node_center").alias("pair_type"))


def center_members(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, min_size: int = 3,
                   min_length: int = MIN_LENGTH, stop_list=None) -> DataFrame:
    """The texts that make up each subtree centre; order them by `seq`."""
    rows = _in_large_subtrees(_cleaned(nodes, min_length, stop_list), assigned, trees, max(min_size, 3))
    return rows.select("post_id", "root_id", "seq", F.col("comment_id").alias("node_id"),
                       F.col("_text").alias("content"))


def center_text_chunks(members: DataFrame, per_chunk: int = 1000, seed: int = 42) -> DataFrame:
    """Centre texts as arrays of at most `per_chunk` texts, however large the subtree is.

    `members` is written once: ranks need its key for the counts and again for the rows.
    """
    ranked = hash_rank(stored(members), ["post_id", "root_id"], ["post_id", "node_id"], seed, "_r")
    chunk = F.floor((F.col("_r") - 1) / per_chunk).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("seq", "node_id", "content")))
    return ranked.groupBy("post_id", "root_id", chunk.alias("chunk")).agg(
        F.transform(listed, lambda x: x["content"]).alias("positive_content_list"))


def center_vectors(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Mean vector of the centre's nodes per subtree."""
    rows = members.select("post_id", "root_id", F.col("node_id").alias("comment_id")).join(
        nodes.select("post_id", "comment_id", "embedding"), ["post_id", "comment_id"])
    return mean_vector(rows, ["post_id", "root_id"])


def single_texts(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, remove_duplicates: bool = True,
                 min_length: int = MIN_LENGTH, max_samples: int | None = None, min_size: int = 2,
                 stop_list=None, seed: int = 42) -> DataFrame:
    """Cleaned texts of subtrees with at least `min_size` nodes; equal texts keep the earliest one.

    The earliest copy is found by a minimum per text, which combines on the map side, so a text with
    very many copies is no hot spot.
    """
    rows = _in_large_subtrees(_cleaned(nodes, min_length, stop_list), assigned, trees, min_size)
    rows = rows.select(F.col("_text").alias("content"), "post_id", "comment_id", "seq")
    if remove_duplicates:
        rows = rows.groupBy("content").agg(F.min(F.struct("seq", "post_id", "comment_id")).alias("_f")).select(
            "content", "_f.post_id", "_f.comment_id", "_f.seq")
    return cap(rows, [], ["post_id", "comment_id"], max_samples, seed).select("content", "post_id", "comment_id")


def with_sample_index(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Add the dense 0-based `sample_index`."""
    return dense_index(df, key, seed, "sample_index")


def negative_pool(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """All raw comment texts, numbered from 0 inside their post."""
    rows = nodes.filter(F.col("parent_id").isNotNull()).select(
        "post_id", "comment_id", F.coalesce("content", F.lit("")).alias("content"))
    return hash_rank(rows, ["post_id"], ["post_id", "comment_id"], seed, "_r").select(
        "post_id", "comment_id", "content", (F.col("_r") - 1).alias("pool_index"))


def cross_thread_negatives(pairs: DataFrame, nodes: DataFrame, key: str = "sample_index", n: int = 1,
                           seed: int = 42) -> DataFrame:
    """n texts from other posts per pair: first a post, then one of its non-empty texts.

    Both draws are hash values that point at dense indexes, so the sampling is three equi-joins. With
    no other post the text is the placeholder.
    """
    filled = nodes.filter(F.col("parent_id").isNotNull() & (F.length("content") > 0))
    pool = negative_pool(filled, seed)
    posts = stored(dense_index(filled.groupBy("post_id").agg(F.count(F.lit(1)).alias("_texts")), ["post_id"], seed, "_post"))
    count = posts.select(F.count(F.lit(1)).alias("n")).scalar()
    slots = pairs.select(key, "post_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    own = lookup(slots, posts.select("post_id", F.col("_post").alias("_own")), ["post_id"], "left", counted=pairs)
    others = count - F.when(F.col("_own").isNull(), 0).otherwise(1)
    draw = F.try_mod(portable_hash(f"{seed}:post", key, "slot"), others)
    drawn = own.withColumn("_draw", draw).withColumn(
        "_post", F.when(F.col("_draw") >= F.col("_own"), F.col("_draw") + 1).otherwise(F.col("_draw")))
    # few other posts, or few texts in one, are drawn by very many pairs: hot keys on both joins
    drawn = stored(drawn.select(key, "post_id", "slot", "_post"))
    chosen = lookup(drawn, posts.select("_post", F.col("post_id").alias("negative_post_id"), "_texts"), ["_post"], "left")
    chosen = chosen.withColumn("pool_index", F.pmod(portable_hash(f"{seed}:text", key, "slot"), F.col("_texts")))
    texts = pool.select(F.col("post_id").alias("negative_post_id"), "pool_index",
                        F.col("comment_id").alias("negative_id"), F.col("content").alias("_negative"))
    return lookup(chosen, texts, ["negative_post_id", "pool_index"], "left").select(
        key, "post_id", "slot", "negative_post_id", "negative_id",
        F.coalesce("_negative", F.lit(UNKNOWN)).alias("negative_content"))


def batch_rows(df: DataFrame, size: int, key: list[str], seed: int = 42) -> DataFrame:
    """Seeded shuffle into batches: batch_id, position in the batch, number of rows in the batch.

    `df` is written once: ranks need its key for the counts and again for the rows.
    """
    ranked = hash_rank(stored(df), [], key, seed, "_r", "_all")
    batch = F.floor((F.col("_r") - 1) / size).cast("bigint")
    return ranked.select(*df.columns, batch.alias("batch_id"), ((F.col("_r") - 1) - batch * size).alias("position"),
                         F.least(F.lit(size), F.col("_all") - batch * size).cast("bigint").alias("batch_size"))


def to_batches(df: DataFrame, size: int, key: list[str], seed: int = 42) -> DataFrame:
    """One row per batch with arrays of texts, post ids and indices; a group has `size` rows at most.

    Understands parent/child pairs (`positive_content`), pairs with a list (`positive_content_list`),
    node/centre pairs that name their centre by (`post_id`, `root_id`), and single texts (`content`).
    """
    rows = batch_rows(df, size, key, seed)
    anchor = "anchor_content" if "anchor_content" in df.columns else "content"
    fields = {"anchor_texts": text_or(anchor)}
    if "positive_content" in df.columns:
        fields["positive_texts"] = text_or("positive_content")
    if "positive_content_list" in df.columns:
        fixed = F.transform("positive_content_list", lambda x: text_or(x))
        fields["positive_text_lists"] = F.when(F.size(fixed) > 0, fixed).otherwise(F.array(F.lit(UNKNOWN)))
    if "negatives" in df.columns:
        fields["negative_texts"] = F.transform("negatives", lambda x: text_or(x))
    if "post_id" in df.columns:
        fields["post_ids"] = F.col("post_id")
    if "root_id" in df.columns:
        fields["root_ids"] = F.col("root_id")
    if "sample_index" in df.columns:
        fields["sample_indices"] = F.col("sample_index")
    items = F.sort_array(F.collect_list(F.struct("position", *[c.alias(k) for k, c in fields.items()])))
    listed = rows.groupBy("batch_id").agg(items.alias("_items"))
    return listed.select("batch_id", *[F.col(f"_items.{k}").alias(k) for k in fields])


def hybrid(batched: DataFrame, ratio: float, remove_duplicates: bool = True) -> DataFrame:
    """Turn the first floor(ratio * n) pairs of each batch into single texts, keep the rest as pairs.

    Single texts come anchors first, then positives, without blanks; equal texts of a batch keep the
    first. `batched` as from `batch_rows`.
    """
    split = F.floor(F.col("batch_size") * F.lit(ratio))
    head = batched.filter(F.col("position") < split)
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("anchor_content").alias("_text")),
        F.struct(F.lit(1).alias("_side"), F.col("positive_content").alias("_text")))).alias("_x")
    singles = head.select("batch_id", "position", "batch_size", sides).select(
        "batch_id", (F.col("_x._side") * F.col("batch_size") + F.col("position")).alias("_order"),
        F.col("_x._text").alias("anchor_content")).filter(~F.col("anchor_content").rlike(r"(?U)\A\s*\z"))
    if remove_duplicates:
        singles = singles.groupBy("batch_id", "anchor_content").agg(F.min("_order").alias("_order"))
    singles = singles.select("batch_id", F.lit("single").alias("part"), F.col("_order").alias("place"),
                             "anchor_content", F.col("anchor_content").alias("positive_content"))
    rest = batched.filter(F.col("position") >= split).select(
        "batch_id", F.lit("pair").alias("part"), F.col("position").alias("place"), "anchor_content", "positive_content")
    return singles.unionByName(rest)


def text_summary(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, min_size: int = 2,
                 min_length: int = MIN_LENGTH, stop_list=None) -> DataFrame:
    """Subtrees used, texts before and after removing equal ones, and their lengths."""
    texts = single_texts(nodes, assigned, trees, False, min_length, None, min_size, stop_list)
    copies = texts.groupBy("content").agg(F.count(F.lit(1)).alias("_n"))
    used = trees.filter(F.col("size") >= min_size).select(F.count(F.lit(1)).alias("n"))
    size = F.length("content")
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("texts_before"), F.count(F.lit(1)).alias("texts_after"),
        F.avg(size).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length")).select(
        used.scalar().alias("subtrees"), "texts_before", "texts_after",
        F.try_divide((F.col("texts_before") - F.col("texts_after")) * 100.0, F.col("texts_before")).alias("dedup_percentage"),
        "mean_length", "min_length", "max_length")
