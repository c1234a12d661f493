"""Reply trees as adjacency tables: assembly, reachability, depth, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from threadgrove.operators.skew import lookup
from threadgrove.session import stored

TOP_LEVEL = "0"  # fixed value: parent id that marks a comment on the post itself


def resolve_parents(comments: DataFrame) -> DataFrame:
    """Replace the top-level marker by the post id and cast all ids to string."""
    post = F.col("note_id").cast("string")
    parent = F.col("parent_comment_id").cast("string")
    return comments.select(
        post.alias("post_id"), F.col("comment_id").cast("string").alias("comment_id"),
        F.when(parent == TOP_LEVEL, post).otherwise(parent).alias("parent_id"),
        F.coalesce("content", F.lit("")).alias("content"), "seq")


def post_text(title, content) -> Column:
    """Title, or the content when the title is empty or missing, or the empty string."""
    return F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(content), F.lit(""))


def post_nodes(posts: DataFrame) -> DataFrame:
    """One root node per post; its parent is NULL."""
    post = F.col("note_id").cast("string")
    return posts.select(post.alias("post_id"), post.alias("comment_id"),
                        F.lit(None).cast("string").alias("parent_id"),
                        post_text("title", "content").alias("content"), F.lit(-1).cast("bigint").alias("seq"))


def duplicate_posts(posts: DataFrame) -> DataFrame:
    """Post ids that occur more than once."""
    return (posts.groupBy(F.col("note_id").cast("string").alias("post_id"))
            .agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1))


def require_unique_posts(posts: DataFrame) -> DataFrame:
    """The posts, or an error when an id is repeated."""
    if not duplicate_posts(posts).isEmpty():
        raise ValueError("a post id occurs more than once")
    return posts


def jump_to_roots(links: DataFrame, keys: list[str], node: str, parent: str, terminal: str,
                  carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """For every node the terminal ancestor it reaches, and the number of edges to it.

    Pointer jumping: each step replaces a node's pointer by its pointer's pointer, so a chain of
    length d needs about log2(d) joins. Only unfinished nodes are joined and rewritten; every step is
    a written table, which cuts the lineage. Nodes whose chain leaves the table, or runs in a cycle,
    are not in the result. Joins are on (keys, node), so a large tree is spread like any other rows;
    a pointer shared by very many nodes is split by `lookup`.

    `carry` columns travel along. `path` names a column whose values are collected from the terminal
    down to the node (length = depth).
    """
    carry = carry or []
    start = links.select(
        *keys, F.col(node).alias("_node"),
        F.when(F.col(terminal), F.col(node)).otherwise(F.col(parent)).alias("_ptr"),
        F.when(F.col(terminal), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("_dist"),
        F.col(terminal).alias("_done"),
        *([F.array(F.col(path)).alias("_path")] if path else []), *carry)

    def step(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        seen = Observation()
        kept = stored(df, seen, open=F.count_if(~F.col("_done")))
        return kept.filter(F.col("_done")), kept.filter(~F.col("_done")), seen.get["open"]

    done, active, open_now = step(start)
    finished = done
    while open_now:
        target = finished.unionByName(active).select(
            *keys, F.col("_node").alias("_ptr"), F.col("_ptr").alias("_next"),
            F.col("_dist").alias("_more"), F.col("_done").alias("_end"),
            *([F.col("_path").alias("_above")] if path else []))
        here = active.drop("_done")
        moved = lookup(here, target, [*keys, "_ptr"]).select(
            *keys, "_node", F.col("_next").alias("_ptr"), (F.col("_dist") + F.col("_more")).alias("_dist"),
            F.col("_end").alias("_done"),
            *([F.concat("_above", "_path").alias("_path")] if path else []), *carry)
        done, active, still_open = step(moved)
        finished = finished.unionByName(done)
        if still_open == open_now:  # nobody arrived: only cycles are left
            break
        open_now = still_open
    return finished.select(*keys, F.col("_node").alias(node), F.col("_ptr").alias("root_id"),
                           F.col("_dist").alias("dist"),
                           *([F.col("_path").alias("path")] if path else []), *carry)


def attach(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Nodes of all posts and of the comments that can be attached to them, with `depth`.

    A comment is attached when its parent is the post, or an attached comment that was listed
    earlier. Comments of unknown posts, replies listed before their parent, and everything below
    them are left out; of equal comment ids in a post the earliest row counts. `posts` as from
    `post_nodes`, `comments` as from `resolve_parents`. Only ids take part in the search; the texts
    join once, at the end.
    """
    first = F.min(F.struct("seq", "parent_id")).alias("_f")
    ids = stored(comments.groupBy("post_id", "comment_id").agg(first).select(
        "post_id", "comment_id", "_f.parent_id", "_f.seq"))
    known = lookup(ids, posts.select("post_id"), ["post_id"], "left_semi")
    parents = ids.select("post_id", F.col("comment_id").alias("parent_id"), F.col("seq").alias("_pseq"))
    top = F.col("parent_id") == F.col("post_id")
    links = lookup(known, parents, ["post_id", "parent_id"], "left", counted=ids).filter(
        top | (F.col("_pseq") < F.col("seq"))).withColumn("_top", top)
    reached = jump_to_roots(links, ["post_id"], "comment_id", "parent_id", "_top", carry=["seq"])
    nodes = comments.join(reached.select("post_id", "comment_id", "seq", "dist"), ["post_id", "comment_id", "seq"]).select(
        "post_id", "comment_id", "parent_id", "content", "seq", (F.col("dist") + 1).alias("depth"))
    roots = posts.select("post_id", "comment_id", "parent_id", "content", "seq",
                         F.lit(0).cast("bigint").alias("depth"))
    return roots.unionByName(nodes)


def with_depth(nodes: DataFrame, path: bool = False) -> DataFrame:
    """Add `depth` (edges to the post) and, on request, `path`, an array that sorts in preorder."""
    links = nodes.select("post_id", "comment_id", "parent_id", F.col("parent_id").isNull().alias("_top"),
                         *([F.struct("seq", "comment_id").alias("_step")] if path else []))
    # the path step is (seq, id): siblings in input order, ids break ties
    out = jump_to_roots(links, ["post_id"], "comment_id", "parent_id", "_top", path="_step" if path else None)
    found = out.drop("root_id").withColumnRenamed("dist", "depth")
    return nodes.drop("depth", "path").join(found, ["post_id", "comment_id"])


def tree_depth(nodes: DataFrame) -> DataFrame:
    """Largest depth per post; `nodes` needs `depth`."""
    return nodes.groupBy("post_id").agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("nodes"))


def flatten(nodes: DataFrame) -> DataFrame:
    """Every node once; sort by (post_id, path) for preorder, by (post_id, depth, path) for breadth."""
    return nodes.dropDuplicates(["post_id", "comment_id"])


def find_nodes(nodes: DataFrame, post_id: str | None = None, comment_id: str | None = None) -> DataFrame:
    """Nodes of one post, one comment id, or both."""
    if post_id is not None:
        nodes = nodes.filter(F.col("post_id") == post_id)
    if comment_id is not None:
        nodes = nodes.filter(F.col("comment_id") == comment_id)
    return nodes
