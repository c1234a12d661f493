"""From raw threads to training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadgrove.operators import forest, pairs, tree
from threadgrove.session import stored

STRATEGIES = ("comment_reply", "node_center", "single_text")


def threads_to_pairs(posts: DataFrame, comments: DataFrame, embeddings: DataFrame, threshold: float,
                     strategy: str = "comment_reply", **options) -> DataFrame:
    """Assemble the threads, cut weak links and emit pairs with a dense `sample_index`.

    `posts` and `comments` as read by `read_threads`; `embeddings`: post_id, comment_id, embedding, for
    the comments that have one. Texts travel once, after the tree is known.
    """
    nodes = tree.attach(tree.post_nodes(tree.require_unique_posts(posts)), tree.resolve_parents(comments))
    nodes = stored(nodes)
    vectors = stored(nodes.drop("content").join(embeddings, ["post_id", "comment_id"], "left"))
    edges, assigned, trees = forest.grow_forest(vectors, threshold)
    if strategy == "comment_reply":
        found, key = pairs.parent_child_pairs(nodes, edges, assigned, trees, **options), ["post_id", "child_id"]
    elif strategy == "node_center":
        found, key = pairs.node_center_pairs(nodes, assigned, trees, **options), ["post_id", "node_id"]
    elif strategy == "single_text":
        found, key = pairs.single_texts(nodes, assigned, trees, **options), ["post_id", "comment_id"]
    else:
        raise ValueError(f"unknown pair strategy: {strategy}")
    return pairs.with_sample_index(stored(found), key)
