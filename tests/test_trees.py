"""Trees and forests on small literal cases and on deep, wide and broken shapes."""

import pytest
from pyspark.sql import functions as F

from threadgrove.functions import vectors
from threadgrove.operators import forest, tree

COMMENT = "note_id string, comment_id string, parent_comment_id string, content string, seq long"


def posts(spark, *ids):
    return tree.post_nodes(spark.createDataFrame([(i, "t", "c") for i in ids], "note_id string, title string, content string"))


def attached(spark, rows, *ids):
    out = tree.attach(posts(spark, *ids), tree.resolve_parents(spark.createDataFrame(rows, COMMENT)))
    return {(x.post_id, x.comment_id): x.depth for x in out.collect()}


def test_attach_rejects_late_orphan_unknown_and_cyclic_comments(spark):
    rows = [("P", "A", "0", "a", 1), ("P", "B", "A", "b", 2),
            ("P", "early", "late", "x", 3), ("P", "late", "0", "x", 4), ("P", "below", "early", "x", 5),
            ("P", "orphan", "nobody", "x", 6), ("P", "X", "Y", "x", 7), ("P", "Y", "X", "x", 8),
            ("Q", "C", "0", "x", 9)]
    assert attached(spark, rows, "P") == {("P", "P"): 0, ("P", "A"): 1, ("P", "B"): 2, ("P", "late"): 1}


def test_equal_comment_ids_keep_the_first(spark):
    rows = [("P", "A", "0", "first", 1), ("P", "A", "0", "second", 2), ("P", "B", "A", "b", 3)]
    out = tree.attach(posts(spark, "P"), tree.resolve_parents(spark.createDataFrame(rows, COMMENT)))
    assert out.filter("comment_id = 'A'").select("content").collect()[0][0] == "first"
    assert out.count() == 3


def test_duplicate_posts_are_an_error(spark):
    df = spark.createDataFrame([("P",), ("P",), ("Q",)], "note_id string")
    assert [tuple(x) for x in tree.duplicate_posts(df).collect()] == [("P", 2)]
    with pytest.raises(ValueError):
        tree.require_unique_posts(df)


def test_missing_title_and_content(spark):
    df = spark.createDataFrame([("1", "t", "c"), ("2", "", "c"), ("3", None, "c"), ("4", None, None)],
                               "note_id string, title string, content string")
    assert [x.content for x in tree.post_nodes(df).orderBy("post_id").collect()] == ["t", "c", "c", ""]


def test_deep_chain_and_wide_star(spark):
    chain = [("P", f"c{i}", "0" if i == 0 else f"c{i - 1}", "", i) for i in range(300)]
    star = [("P", f"s{i}", "c0", "", 1000 + i) for i in range(500)]
    got = attached(spark, chain + star, "P")
    assert len(got) == 801
    assert all(got[("P", f"c{i}")] == i + 1 for i in range(300))
    assert all(got[("P", f"s{i}")] == 2 for i in range(500))


def test_star_is_the_same_when_its_centre_is_split(spark, monkeypatch):
    import threadgrove.operators.skew as skew
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    star = [("P", "c0", "0", "", 0)] + [("P", f"s{i}", "c0", "", 1 + i) for i in range(200)]
    got = attached(spark, star, "P")
    assert len(got) == 202 and got[("P", "s199")] == 2


def test_cycles_end_the_search(spark):
    links = spark.createDataFrame([("P", "a", "a", True), ("P", "b", "a", False), ("P", "x", "y", False), ("P", "y", "x", False), ("P", "z", "x", False)],
                                  "k string, n string, p string, t boolean")
    out = tree.jump_to_roots(links, ["k"], "n", "p", "t")
    assert {(x.n, x.root_id, x.dist) for x in out.collect()} == {("a", "a", 0), ("b", "a", 1)}


def test_paths_sort_in_preorder(spark):
    rows = [("P", "P", None, 0), ("P", "A", "P", 1), ("P", "B", "P", 2), ("P", "C", "A", 3), ("P", "D", "B", 4), ("P", "E", "C", 5)]
    n = spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, seq long")
    out = tree.with_depth(n, path=True).orderBy("post_id", "path").collect()
    assert [x.comment_id for x in out] == ["P", "A", "C", "E", "B", "D"]
    assert [x.depth for x in out] == [0, 1, 2, 3, 1, 2]


UP, SIDE = [1.0, 0.0], [0.0, 1.0]
NODE = "post_id string, comment_id string, parent_id string, embedding array<float>"


def grown(spark, rows, threshold=0.5):
    edges, assigned, trees = forest.grow_forest(spark.createDataFrame(rows, NODE), threshold)
    return edges, assigned, {x.root_id: (x.original_parent_id, x.size, x.depth) for x in trees.collect()}


BASE = [("P", "P", None, SIDE), ("P", "A", "P", UP), ("P", "B", "P", UP), ("P", "D", "A", UP), ("P", "F", "D", UP), ("P", "E", "C", SIDE)]


def test_a_cut_in_the_middle(spark):
    _, _, trees = grown(spark, [*BASE, ("P", "C", "A", SIDE)])
    assert trees == {"A": ("P", 3, 2), "B": ("P", 1, 0), "C": ("A", 2, 1)}


def test_missing_vector_is_kept_and_logged(spark):
    rows = [(p, c, q, None if c == "D" else v) for p, c, q, v in [*BASE, ("P", "C", "A", SIDE)]]
    edges, _, trees = grown(spark, rows)
    assert trees["A"] == ("P", 3, 2)
    log = {(x.parent_id, x.child_id): (x.similarity_score, x.reason) for x in forest.cut_edge_log(edges).collect()}
    assert log == {("A", "C"): (0.0, forest.BELOW), ("A", "D"): (-1.0, forest.MISSING), ("D", "F"): (-1.0, forest.MISSING)}


@pytest.mark.parametrize("sim", [vectors.cosine, vectors.cosine_expr])
def test_zero_vector_counts_as_below(spark, sim):
    rows = [("P", "P", None, UP), ("P", "A", "P", UP), ("P", "Z", "A", [0.0, 0.0]), ("P", "Y", "A", UP)]
    edges = forest.prune(forest.edge_similarity(spark.createDataFrame(rows, NODE), sim), -1.0)
    assert {x.child_id: x.kept for x in edges.collect()} == {"Z": False, "Y": True}


def test_histogram_keeps_or_closes_the_gap(spark):
    sizes = [1, 2, 3, 5, 10, 20, 50, 60, 99, 100]
    t = spark.createDataFrame([("P", f"r{i}", s) for i, s in enumerate(sizes)], "post_id string, root_id string, size long")
    legacy = {x.bin: (x["count"], x.percentage) for x in forest.size_histogram(t, legacy_bins=True).collect()}
    assert legacy == {b: (1, 10.0) for b in ["1", "2-2", "3-3", "4-5", "6-10", "11-20", "21-50", "100+"]}
    full = {x.bin: x["count"] for x in forest.size_histogram(t).collect()}
    assert full["51-99"] == 2 and sum(full.values()) == 10


def test_invariants_over_thresholds(spark):
    from threadgrove.queries.base import thread_nodes
    nodes = thread_nodes(spark, "/root/testdata/sf0.001").cache()
    comments = nodes.filter("parent_id is not null").count()
    first = nodes.filter("parent_id = post_id").count()
    last = 0
    for t in (-0.2, 0.0, 0.1):
        edges, _, trees = forest.grow_forest(nodes, t)
        n, total = trees.agg(F.count("*"), F.sum("size")).first()
        assert total == comments and n == first + edges.filter("not kept").count() and n >= last
        last = n
