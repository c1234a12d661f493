"""Cutting weak parent-child links, and what the resulting forests look like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from threadgrove.functions import vectors
from threadgrove.functions.rows import beside
from threadgrove.operators.ranking import best_per_group, exact_quantiles, take_by_hash
from threadgrove.operators.skew import lookup
from threadgrove.operators.tree import jump_to_roots
from threadgrove.session import stored

BELOW = "similarity_below_threshold"  # fixed values: reasons in the cut-edge log
MISSING = "embedding_missing"
QUARTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def edge_similarity(nodes: DataFrame, sim: Callable[[Column, Column], Column] = vectors.cosine) -> DataFrame:
    """Similarity of every comment to its parent comment; links to the post itself are no edges.

    `nodes`: post_id, comment_id, parent_id, embedding. A missing vector gives NULL. The join is on
    (post, parent), so large posts spread; parents with very many replies are split.
    """
    comments = nodes.filter(F.col("parent_id").isNotNull())
    child = comments.filter(F.col("parent_id") != F.col("post_id")).select(
        "post_id", "parent_id", F.col("comment_id").alias("child_id"), F.col("embedding").alias("_child"))
    parent = comments.select("post_id", F.col("comment_id").alias("parent_id"),
                             F.col("embedding").alias("_parent"))
    joined = lookup(child, parent, ["post_id", "parent_id"])
    return joined.select("post_id", "parent_id", "child_id",
                         sim(F.col("_parent"), F.col("_child")).alias("similarity"))


def at_least(similarity: str, threshold) -> Column:
    """`similarity >= threshold`, false for NaN (Spark sorts NaN above every number)."""
    return (~F.isnan(similarity)) & (F.col(similarity) >= threshold)


def prune(edges: DataFrame, threshold: float | None = None) -> DataFrame:
    """Decide every edge: kept when similar enough or when a vector is missing, else cut.

    The threshold is one number, or the column `threshold` of the edges. Adds `kept`, `logged` (cut, or kept without a vector), `reason`, `threshold`, `similarity_score`.
    """
    if "threshold" not in edges.columns:
        edges = edges.withColumn("threshold", F.lit(threshold).cast("double"))
    missing = F.col("similarity").isNull()
    passed = F.coalesce(at_least("similarity", F.col("threshold")), F.lit(False))
    return edges.select(
        "*", (missing | passed).alias("kept"), (missing | ~passed).alias("logged"),
        F.when(missing, F.lit(MISSING)).when(~passed, F.lit(BELOW)).alias("reason"),
        F.coalesce("similarity", F.lit(-1.0)).alias("similarity_score"))


def cut_edge_log(pruned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cut edges, and kept edges whose similarity is unknown (score -1)."""
    return pruned.filter("logged").select(
        *keys, "post_id", "parent_id", "child_id", "similarity_score",
        *([] if "threshold" in keys else ["threshold"]), "reason")


def assign_roots(nodes: DataFrame, pruned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The subtree root of every comment after cutting, with its distance from that root.

    First-level comments and the lower ends of cut edges are roots. `keys` are extra columns that
    `pruned` carries (a sweep); `nodes` must carry them too.
    """
    first = nodes.filter(F.col("parent_id") == F.col("post_id")).select(
        *keys, "post_id", "comment_id", "parent_id", F.lit(True).alias("_root"))
    below = pruned.select(*keys, "post_id", F.col("child_id").alias("comment_id"), "parent_id",
                          (~F.col("kept")).alias("_root"))
    return jump_to_roots(first.unionByName(below), [*keys, "post_id"], "comment_id", "parent_id",
                         "_root", carry=["parent_id"])


def subtrees(assigned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Size, depth and original parent of every subtree."""
    own = F.col("comment_id") == F.col("root_id")
    return assigned.groupBy(*keys, "post_id", "root_id").agg(
        F.max(F.when(own, F.col("parent_id"))).alias("original_parent_id"),
        F.count(F.lit(1)).alias("size"), F.max("dist").alias("depth"))


def grow_forest(nodes: DataFrame, threshold: float, sim=vectors.cosine) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pruned edges, assigned nodes, subtrees); similarities are computed once and stored."""
    edges = stored(prune(edge_similarity(nodes, sim), threshold))
    assigned = assign_roots(nodes, edges)
    return edges, assigned, subtrees(assigned)


# ---- per-forest and overall figures -------------------------------------------------------------

def similarity_distribution(edges: DataFrame, by: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """Count, mean, population std, range and quantiles of the known similarities.

    A post whose edges are all without a usable similarity has a row with count 0 and null figures.
    """
    known = edges.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity")))
    basic = [F.count("similarity").alias("count"), F.avg("similarity").alias("mean"),
             F.stddev_pop("similarity").alias("std"), F.min("similarity").alias("min"),
             F.max("similarity").alias("max")]
    plain = known.groupBy(*by).agg(*basic)
    quantiles = exact_quantiles(known, "similarity", QUARTILES, list(by))
    return plain.join(quantiles, list(by), "left") if by else beside(plain, quantiles)


def similarity_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Posts in all, posts with a usable edge, number of usable edges."""
    posts = nodes.filter(F.col("parent_id").isNull()).select(F.count(F.lit(1)).alias("total_posts"))
    valid = edges.filter(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
    pairs = valid.groupBy("post_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(F.count(F.lit(1)).alias("posts_with_valid_similarities"),
                     F.coalesce(F.sum("_n"), F.lit(0)).alias("total_similarity_pairs")).select(
        posts.scalar().alias("total_posts"), "posts_with_valid_similarities", "total_similarity_pairs")


def similarity_listing(distribution: DataFrame, n: int = 10) -> DataFrame:
    """The figures of the first n posts, by id, that have a usable similarity."""
    return (distribution.filter(F.col("count") > 0).orderBy("post_id").limit(n)
            .select("post_id", "count", "mean", "std", "median", "min", "max"))


def similarity_variability(distribution: DataFrame) -> DataFrame:
    """Spread of the per-post means and standard deviations."""
    return distribution.filter(F.col("count") > 0).agg(
        F.count(F.lit(1)).alias("posts"),
        F.min("mean").alias("min_mean"), F.max("mean").alias("max_mean"), F.stddev_pop("mean").alias("std_mean"),
        F.min("std").alias("min_std"), F.max("std").alias("max_std"), F.stddev_pop("std").alias("std_std"))


def forest_stats(trees: DataFrame, pruned: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per post: subtree count, node count, size and depth figures, logged edges."""
    by = [*keys, "post_id"]
    cuts = pruned.groupBy(*by).agg(F.count_if("logged").alias("cut_edges_count"))
    stats = trees.groupBy(*by).agg(
        F.count(F.lit(1)).alias("subtree_count"), F.sum("size").alias("total_nodes"),
        F.avg("size").alias("avg_subtree_size"), F.max("size").alias("max_subtree_size"),
        F.min("size").alias("min_subtree_size"), F.avg("depth").alias("avg_depth"),
        F.max("depth").alias("max_depth"))
    return stats.join(cuts, by, "left").fillna(0, ["cut_edges_count"])


def all_forest_stats(stats: DataFrame) -> DataFrame:
    """Totals over all posts and averages per post."""
    return stats.agg(
        F.count(F.lit(1)).alias("total_posts"), F.sum("subtree_count").alias("total_subtrees"),
        F.sum("total_nodes").alias("total_nodes"), F.sum("cut_edges_count").alias("total_cut_edges"),
        F.avg("subtree_count").alias("avg_subtrees_per_post"), F.avg("total_nodes").alias("avg_nodes_per_post"),
        F.avg("cut_edges_count").alias("avg_cut_edges_per_post"))


def _valid_score(score: str = "similarity_score") -> Column:
    return (F.col(score) >= 0) & ~F.isnan(score)


def cut_edge_stats(log: DataFrame) -> DataFrame:
    """Per post: logged edges, those with a score of at least 0, and figures over the latter."""
    s = F.when(_valid_score(), F.col("similarity_score"))
    plain = log.groupBy("post_id").agg(
        F.count(F.lit(1)).alias("total_cut_edges"), F.count(s).alias("valid_similarity_count"),
        F.avg(s).alias("avg_similarity"), F.min(s).alias("min_similarity"),
        F.max(s).alias("max_similarity"), F.stddev_pop(s).alias("std_similarity"))
    medians = exact_quantiles(log.filter(_valid_score()), "similarity_score",
                              {"median_similarity": 0.5}, ["post_id"])
    return plain.filter("valid_similarity_count > 0").join(medians, "post_id")


def cut_edges_between(log: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Logged edges with a score in [low, high]."""
    return log.filter(F.col("similarity_score").between(low, high) & ~F.isnan("similarity_score"))


def cut_edge_histogram(log: DataFrame) -> DataFrame:
    """Share of the valid scores in ten bins of width 0.1; the last bin takes everything above 0.9."""
    bounds = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]  # fixed values
    label = F.lit("0.9-1.0")
    for hi in reversed(bounds):
        label = F.when(F.col("similarity_score") < hi, F.lit(f"{hi - 0.1:.1f}-{hi:.1f}")).otherwise(label)
    return _share(log.filter(_valid_score()).withColumn("bin", label), "bin")


def cut_reasons(log: DataFrame) -> DataFrame:
    """Count and share of every cut reason."""
    return _share(log, "reason")


def _share(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    everything = F.sum("count").over(Window.partitionBy(F.lit(0)))  # over a handful of labels
    return counted.withColumn("percentage", F.col("count") * 100.0 / everything)


LEGACY_BINS = [("1", 1, 1), ("2-2", 2, 2), ("3-3", 3, 3), ("4-5", 4, 5), ("6-10", 6, 10),
               ("11-20", 11, 20), ("21-50", 21, 50), ("100+", 100, None)]  # fixed values, 51-99 has no bin
GAP_BIN = ("51-99", 51, 99)
SAMPLE_GROUPS = [("1", 1), ("2", 2), ("3", 3), ("4-5", 5), ("6-10", 10), ("11-20", 20), ("21-50", 50),
                 ("51-100", 100)]  # fixed values: label and upper bound; above is "100+"


def size_histogram(trees: DataFrame, by: tuple[str, ...] = ("post_id",), legacy_bins: bool = False) -> DataFrame:
    """Subtrees per size bin, with the share of all subtrees. `legacy_bins` leaves 51-99 without a bin."""
    label = F.lit(None).cast("string")
    for name, lo, hi in LEGACY_BINS + ([] if legacy_bins else [GAP_BIN]):
        inside = (F.col("size") >= lo) if hi is None else F.col("size").between(lo, hi)
        label = F.when(inside, F.lit(name)).otherwise(label)
    counted = trees.groupBy(*by, label.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    everything = F.sum("count").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counted.withColumn("percentage", F.col("count") * 100.0 / everything).filter("bin is not null")


def size_distribution(trees: DataFrame, by: tuple[str, ...] = ("post_id",)) -> DataFrame:
    """Basic figures, quantiles and small/medium/large classes of the subtree sizes.

    Equal sizes are counted first; a group has at most sqrt(2 * nodes) different sizes, which bounds
    what the weighted percentile holds.
    """
    counted = trees.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    mean = F.sum(F.col("size") * F.col("_n")) / n
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    centre = F.sum(F.col("size") * F.col("_n")).over(group) / F.sum("_n").over(group)
    sizes = counted.withColumn("_off", F.col("size").cast("double") - centre)
    variance = F.sum(F.col("_off") * F.col("_off") * F.col("_n")) / n
    quant = F.percentile("size", [0.5, 0.25, 0.75, 0.9, 0.95], F.col("_n"))
    out = sizes.groupBy(*by).agg(
        F.sum(F.col("size") * F.col("_n")).alias("total_nodes"), n.alias("subtree_count"),
        mean.alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"),
        F.sqrt(variance).alias("std_size"), quant.alias("_q"),
        F.coalesce(F.sum(F.when(F.col("size") <= 3, F.col("_n"))), F.lit(0)).alias("small_trees"),
        F.coalesce(F.sum(F.when(F.col("size").between(4, 10), F.col("_n"))), F.lit(0)).alias("medium_trees"),
        F.coalesce(F.sum(F.when(F.col("size") > 10, F.col("_n"))), F.lit(0)).alias("large_trees"))
    names = ["median_size", "p25_size", "p75_size", "p90_size", "p95_size"]
    return out.select("*", *[F.col("_q")[i].alias(k) for i, k in enumerate(names)]).drop("_q")


def size_frequencies(trees: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent subtree sizes."""
    return _share(trees, "size").orderBy(F.desc("count"), "size").limit(top)


def largest_subtrees(trees: DataFrame, n: int = 5) -> DataFrame:
    """The n largest subtrees of every post."""
    return best_per_group(trees, ["post_id"], [F.desc("size"), F.asc("root_id")], n, "rank")


def subtrees_between(trees: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """Subtrees with low <= size <= high."""
    out = trees.filter(F.col("size") >= low)
    return out if high is None else out.filter(F.col("size") <= high)


def summary_labels(distribution: DataFrame) -> DataFrame:
    """Dominant size class (the first wins a tie) and fragmentation level."""
    s, m, g = F.col("small_trees"), F.col("medium_trees"), F.col("large_trees")
    avg = F.col("avg_size")
    dominant = F.when((s >= m) & (s >= g), F.lit("small")).when(m >= g, F.lit("medium")).otherwise(F.lit("large"))
    level = (F.when(F.col("subtree_count") <= 1, F.lit("none")).when(avg >= 10, F.lit("low"))
             .when(avg >= 5, F.lit("medium")).when(avg >= 2, F.lit("high")).otherwise(F.lit("very high")))
    share = F.greatest(s, m, g) * 100.0 / F.col("subtree_count")
    return distribution.select(
        *[c for c in ("threshold", "post_id") if c in distribution.columns],
        "subtree_count", "total_nodes", dominant.alias("dominant_category"),
        share.alias("dominant_percentage"), level.alias("fragmentation_level"))


def path_minima(edges: DataFrame) -> list[DataFrame]:
    """Lifting table of the reply edges: level j has, for every comment with 2^j ancestors, the 2^j-th of them (`up`) and the smallest
    similarity on the way (`least`).

    A missing similarity never cuts, so it counts as infinite; NaN always cuts. Each level is the one before joined with itself
    and holds only comments that deep, so the table has about log2(depth) levels. Comments above which a cycle lies never run out; levels
    end when nothing else is left.
    """
    s = F.col("similarity")
    weight = F.when(s.isNull(), F.lit(float("inf"))).when(F.isnan(s), F.lit(float("-inf"))).otherwise(s)
    levels, rows = [], None
    level = edges.select("post_id", F.col("child_id").alias("comment_id"), F.col("parent_id").alias("up"), weight.alias("least"))
    while True:
        seen = Observation()
        level = stored(level, seen, n=F.count(F.lit(1)))
        n = seen.get["n"]
        if levels and n in (0, rows):
            return levels
        levels.append(level)
        rows = n
        above = level.select("post_id", F.col("comment_id").alias("up"), F.col("up").alias("_next"), F.col("least").alias("_more"))
        level = lookup(level, above, ["post_id", "up"]).select("post_id", "comment_id", F.col("_next").alias("up"), F.least("least", "_more").alias("least"))


def roots_by_threshold(nodes: DataFrame, levels: list[DataFrame], thresholds: list[float]) -> DataFrame:
    """post_id, comment_id, root_id, dist, first, last: the subtree root of a comment for the thresholds first … last (places in the
    ascending list) that share it.

    A descent through the lifting table: from the highest level on, the thresholds up to `least` move on by 2^j comments, the
    others stay. A row is split only where thresholds part, so there are as many rows as a comment has different roots, however many
    thresholds are asked for. Comments whose way up leaves the table or is a cycle have no root.
    """
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    passed = lambda least: F.size(F.filter(marks, lambda t: t <= least))
    comments = nodes.filter(F.col("parent_id").isNotNull())
    here = comments.select("post_id", "comment_id", F.col("comment_id").alias("root_id"), F.lit(0).cast("bigint").alias("dist"),
                           F.lit(0).alias("first"), F.lit(len(thresholds) - 1).alias("last"))
    for j in reversed(range(len(levels))):
        step = levels[j].select("post_id", F.col("comment_id").alias("root_id"), "up", "least")
        met = lookup(here, step, ["post_id", "root_id"], "left").withColumn("_p", F.when(F.col("up").isNull(), 0).otherwise(passed(F.col("least"))))
        moved = F.struct(F.col("up").alias("root_id"), (F.col("dist") + (1 << j)).alias("dist"), F.col("first"), F.least(F.col("last"), F.col("_p") - 1).alias("last"))
        stays = F.struct("root_id", "dist", F.greatest("first", "_p").alias("first"), "last")
        pieces = F.array_compact(F.array(F.when(F.col("first") < F.col("_p"), moved), F.when(F.col("last") >= F.col("_p"), stays)))
        here = stored(met.select("post_id", "comment_id", F.inline(pieces)))
    # a root answers the post itself, or its own edge is cut
    tops = comments.filter(F.col("parent_id") == F.col("post_id")).select("post_id", F.col("comment_id").alias("root_id"), F.lit(0).alias("_p"))
    below = levels[0].select("post_id", F.col("comment_id").alias("root_id"), passed(F.col("least")).alias("_p"))
    ended = lookup(here, tops.unionByName(below), ["post_id", "root_id"])
    return ended.withColumn("first", F.greatest("first", "_p")).filter(F.col("first") <= F.col("last")).drop("_p")


def threshold_sweep(nodes: DataFrame, thresholds=(0.3, 0.5, 0.7, 0.9), sim=vectors.cosine) -> DataFrame:
    """Forest figures per post for any number of thresholds.

    Similarities and the lifting table are computed once; a further threshold costs no join, only its rows in the figures.
    """
    marks = sorted({float(t) for t in thresholds})
    edges = stored(edge_similarity(nodes, sim))
    roots = roots_by_threshold(nodes, path_minima(edges), marks)
    # few pieces per root: one for each pair of thresholds at most
    pieces = roots.groupBy("post_id", "root_id", "first", "last").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("depth"))
    held = pieces.groupBy("post_id", "root_id").agg(F.collect_list(F.struct("first", "last", "n", "depth")).alias("_in"))

    def figures(i: Column) -> Column:
        inside = F.filter("_in", lambda x: i.between(x["first"], x["last"]))
        return F.struct(F.element_at(F.array(*[F.lit(t) for t in marks]), i + 1).alias("threshold"),
                        F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("size"),
                        F.array_max(F.transform(inside, lambda x: x["depth"])).alias("depth"))

    trees = held.select("post_id", "root_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(len(marks) - 1)), figures))).filter("size > 0")
    each = F.explode(F.array(*[F.lit(t) for t in marks])).alias("threshold")
    return forest_stats(trees, prune(edges.select("*", each)), ("threshold",))


def sample_by_size(trees: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """Up to n subtrees per size group, with the group size and sampling rate in percent."""
    label = F.lit("100+")
    for name, hi in reversed(SAMPLE_GROUPS):
        label = F.when(F.col("size") <= hi, F.lit(name)).otherwise(label)
    grouped = trees.withColumn("size_group", label)
    totals = grouped.groupBy("size_group").agg(F.count(F.lit(1)).alias("group_total"))
    picked = take_by_hash(grouped, ["size_group"], ["post_id", "root_id"], n, seed)
    return picked.join(totals, "size_group").withColumn(
        "sampling_rate", F.least(F.lit(n), F.col("group_total")) * 100.0 / F.col("group_total"))


def before_after(nodes: DataFrame, trees: DataFrame, pruned: DataFrame) -> DataFrame:
    """Nodes and edges of every tree before and after cutting; edges include those to the post."""
    before = nodes.groupBy("post_id").agg(F.count(F.lit(1)).alias("original_nodes")).withColumn(
        "original_edges", F.col("original_nodes") - 1)
    after = trees.groupBy("post_id").agg(F.sum("size").alias("forest_nodes"), F.count(F.lit(1)).alias("subtree_count"))
    cuts = pruned.groupBy("post_id").agg(F.count_if("logged").alias("cut_edges"))
    joined = before.join(after, "post_id").join(cuts, "post_id", "left").fillna(0, ["cut_edges"])
    return joined.withColumn("remaining_edges", F.col("original_edges") - F.col("cut_edges")).withColumn(
        "cut_percentage", F.try_divide(F.col("cut_edges") * 100.0, F.col("original_edges")))


def outline(nodes: DataFrame, assigned: DataFrame, trees: DataFrame, log: DataFrame, post_id: str | None = None,
            max_depth: int | None = None, max_subtrees: int | None = None, min_size: int = 2,
            preview: int = 50) -> DataFrame:
    """Listing of the forests: one row per node and per cut edge below it, in preorder of `path`.

    `nodes` needs `path` (see `with_depth`). `max_subtrees` keeps the first subtrees of a post in the
    order of their roots' paths.
    """
    if post_id is not None:
        nodes, assigned, trees, log = [d.filter(F.col("post_id") == post_id) for d in (nodes, assigned, trees, log)]
    shown = trees.filter(F.col("size") >= min_size)
    if max_subtrees is not None:
        starts = nodes.select("post_id", F.col("comment_id").alias("root_id"), F.col("path").alias("_start"))
        shown = best_per_group(shown.join(starts, ["post_id", "root_id"]), ["post_id"], [F.asc("_start")],
                               max_subtrees).drop("_start")
    text = F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("...")))
    rows = (lookup(assigned.select("post_id", "comment_id", "root_id", "dist"),
                   shown.select("post_id", "root_id", "size"), ["post_id", "root_id"])
            .join(nodes.select("post_id", "comment_id", "content", "path"), ["post_id", "comment_id"]))
    if max_depth is not None:
        rows = rows.filter(F.col("dist") <= max_depth)
    label = F.when(F.col("dist") == 0, F.lit("ROOT")).otherwise(F.concat(F.lit("L"), F.col("dist")))
    kept = rows.select("post_id", "root_id", "path", F.lit("node").alias("kind"), "comment_id",
                       label.alias("label"), F.coalesce(text, "content").alias("preview"),
                       F.lit(None).cast("double").alias("similarity"))
    cuts = lookup(  # a comment with very many cut replies is a hot key
        log.select("post_id", F.col("parent_id").alias("comment_id"), "child_id", "reason", "similarity_score"),
        rows.select("post_id", "root_id", "path", "comment_id"), ["post_id", "comment_id"]).select(
        "post_id", "root_id", "path", F.lit("cut").alias("kind"), F.col("child_id").alias("comment_id"),
        F.lit("CUT").alias("label"), F.col("reason").alias("preview"), F.col("similarity_score").alias("similarity"))
    return kept.unionByName(cuts)
