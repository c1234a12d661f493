"""Checked queries: scans, tree assembly, similarities, forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadgrove.functions import vectors
from threadgrove.operators import forest, tree
from threadgrove.queries.base import EDGES, NODES, forest_sql, hash_sql, pruned_sql, query, r, table, thread_nodes, tidy, with_
from threadgrove.functions.hashing import portable_hash
from threadgrove.session import stored

T0 = 0.05  # fixture vectors are nearly orthogonal; this cuts roughly half of the edges


def _raw_posts(spark, sf):
    docs = table(spark, sf, "documents")
    n = thread_nodes(spark, sf, vectors=False).filter("parent_id is null")
    titled = docs.select(F.col("doc_id").alias("seq"),
                         F.when(F.col("lang") == "en", F.concat(F.lit("Title: "), "text")).otherwise("").alias("title"))
    return n.join(titled, "seq").select(F.col("post_id").alias("note_id"), "title", "content")


def _raw_comments(spark, sf, shuffled=False):
    n = thread_nodes(spark, sf, vectors=False).filter("parent_id is not null")
    top = F.col("parent_id") == F.col("post_id")
    seq = portable_hash("arrival", "comment_id") if shuffled else F.col("seq")
    return n.select("comment_id", F.col("post_id").alias("note_id"),
                    F.when(top, tree.TOP_LEVEL).otherwise(F.col("parent_id")).alias("parent_comment_id"),
                    "content", seq.alias("seq"))


_RAW_POSTS = """
raw_posts AS (SELECT n.post_id AS note_id, CASE WHEN d.lang='en' THEN 'Title: '||d.text ELSE '' END AS title, n.content
              FROM nodes n JOIN documents d ON d.doc_id = n.seq WHERE n.parent_id IS NULL)"""


@query("b1_resolve_parents", with_(NODES, "SELECT post_id, comment_id, parent_id, content, seq FROM nodes WHERE parent_id IS NOT NULL"))
def _(spark, sf):
    return tree.resolve_parents(_raw_comments(spark, sf))


@query("b2_post_text", with_(NODES + "," + _RAW_POSTS, "SELECT note_id AS post_id, CASE WHEN title<>'' THEN title ELSE content END AS content FROM raw_posts"))
def _(spark, sf):
    return tree.post_nodes(_raw_posts(spark, sf)).select("post_id", "content")


@query("b3_attach", with_(NODES + f""",
late AS (SELECT post_id, comment_id, parent_id, {hash_sql('arrival','comment_id')} AS seq FROM nodes WHERE parent_id IS NOT NULL),
ok AS (
  SELECT post_id, comment_id, parent_id, seq, 1::BIGINT AS depth FROM late WHERE parent_id = post_id
  UNION ALL
  SELECT c.post_id, c.comment_id, c.parent_id, c.seq, ok.depth + 1 FROM late c
  JOIN ok ON ok.post_id = c.post_id AND ok.comment_id = c.parent_id AND ok.seq < c.seq)""",
    "SELECT post_id, comment_id, parent_id, depth FROM ok UNION ALL SELECT post_id, comment_id, NULL, 0 FROM nodes WHERE parent_id IS NULL"))
def _(spark, sf):
    attached = tree.attach(tree.post_nodes(_raw_posts(spark, sf)),
                           tree.resolve_parents(_raw_comments(spark, sf, shuffled=True)))
    return attached.select("post_id", "comment_id", "parent_id", "depth")


@query("b4_duplicate_posts", """SELECT 'd'||conv_id AS post_id, count(*) AS copies FROM conversations GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    turns = table(spark, sf, "conversations")
    return tree.duplicate_posts(turns.select(F.concat(F.lit("d"), "conv_id").alias("note_id")))


def _chat_nodes(spark, sf):
    """Conversations as chains: the first turn is the post, every later turn answers the one before."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")  # a conversation is a handful of turns
    post = F.concat(F.lit("p"), "conv_id")
    ids = table(spark, sf, "conversations").select(
        post.alias("post_id"), F.concat(F.lit("t"), "conv_id", F.lit("_"), "turn").alias("_id"),
        F.row_number().over(w).alias("_i"), F.col("text").alias("content"), F.col("turn").alias("seq"), "conv_id")
    w2 = Window.partitionBy("conv_id").orderBy("_i")
    named = ids.withColumn("comment_id", F.when(F.col("_i") == 1, F.col("post_id")).otherwise(F.col("_id")))
    return named.select("post_id", "comment_id", F.lag("comment_id").over(w2).alias("parent_id"), "content", "seq")


_CHAT = """
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
chat AS (SELECT 'p'||conv_id AS post_id, CASE WHEN i=1 THEN 'p'||conv_id ELSE 't'||conv_id||'_'||turn END AS comment_id, i, text AS content, turn AS seq FROM t)"""


@query("b5_flatten", with_(NODES, "SELECT post_id, comment_id, content FROM nodes"))
def _(spark, sf):
    return tree.flatten(thread_nodes(spark, sf)).select("post_id", "comment_id", "content")


@query("b6_depth", with_(_CHAT, "SELECT post_id, comment_id, i - 1 AS depth FROM chat"))
def _(spark, sf):
    return tree.with_depth(_chat_nodes(spark, sf).drop("content")).select("post_id", "comment_id", "depth")


@query("b6_path", with_(NODES + """,
paths AS (SELECT post_id, comment_id, comment_id AS path, 0::BIGINT AS depth FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT n.post_id, n.comment_id, p.path || '>' || n.comment_id, p.depth + 1 FROM nodes n
  JOIN paths p ON p.post_id = n.post_id AND p.comment_id = n.parent_id)""", "SELECT post_id, comment_id, path, depth FROM paths"))
def _(spark, sf):
    n = tree.with_depth(thread_nodes(spark, sf).drop("content", "embedding"), path=True)
    return n.select("post_id", "comment_id", F.array_join(F.transform("path", lambda s: s.comment_id), ">").alias("path"), "depth")


@query("b6_tree_depth", with_(_CHAT, "SELECT post_id, max(i) - 1 AS max_depth, count(*) AS nodes FROM chat GROUP BY ALL"))
def _(spark, sf):
    return tree.tree_depth(tree.with_depth(_chat_nodes(spark, sf)))


@query("b7_lookup", with_(NODES, "SELECT post_id, comment_id, parent_id, seq FROM nodes WHERE post_id = 'p3' AND comment_id = 'c67'"))
def _(spark, sf):
    return tree.find_nodes(thread_nodes(spark, sf), "p3", "c67").select("post_id", "comment_id", "parent_id", "seq")


@query("b8_outline", with_(forest_sql(T0), """
, shown AS (SELECT a.*, n.content FROM assigned a JOIN trees t USING (post_id, root_id) JOIN nodes n USING (post_id, comment_id) WHERE t.size >= 2)
SELECT post_id, root_id, 'node' AS kind, comment_id, CASE WHEN dist=0 THEN 'ROOT' ELSE 'L'||dist END AS label,
       CASE WHEN length(content)>50 THEN substr(content,1,50)||'...' ELSE content END AS preview, NULL::DOUBLE AS similarity
FROM shown WHERE dist <= 2
UNION ALL
SELECT s.post_id, s.root_id, 'cut', l.child_id, 'CUT', l.reason, round(l.similarity_score,6)+0.0
FROM shown s JOIN log l ON l.post_id=s.post_id AND l.parent_id=s.comment_id WHERE dist <= 2""".replace("\n, shown", ", shown", 1)))
def _(spark, sf):
    nodes = stored(tree.with_depth(thread_nodes(spark, sf), path=True))
    edges, assigned, trees = forest.grow_forest(nodes, T0)
    out = forest.outline(nodes, assigned, trees, forest.cut_edge_log(edges), max_depth=2)
    return tidy(out.orderBy("post_id", "root_id", "path", F.desc("kind")).drop("path"))


@query("b8_full_outline", with_(forest_sql(T0), """
, shown AS (SELECT a.*, n.content FROM assigned a JOIN trees t USING (post_id, root_id) JOIN nodes n USING (post_id, comment_id) WHERE t.size >= 2)
SELECT post_id, root_id, 'node' AS kind, comment_id, CASE WHEN dist=0 THEN 'ROOT' ELSE 'L'||dist END AS label,
       CASE WHEN length(content)>50 THEN substr(content,1,50)||'...' ELSE content END AS preview, NULL::DOUBLE AS similarity
FROM shown 
UNION ALL
SELECT s.post_id, s.root_id, 'cut', l.child_id, 'CUT', l.reason, round(l.similarity_score,6)+0.0
FROM shown s JOIN log l ON l.post_id=s.post_id AND l.parent_id=s.comment_id""".replace("\n, shown", ", shown", 1)))
def _(spark, sf):
    nodes = stored(tree.with_depth(thread_nodes(spark, sf), path=True))
    edges, assigned, trees = forest.grow_forest(nodes, T0)
    out = forest.outline(nodes, assigned, trees, forest.cut_edge_log(edges))
    return tidy(out.orderBy("post_id", "root_id", "path", F.desc("kind")).drop("path"))


# ---- similarities ---------------------------------------------------------------------------------

_SIM = "CASE WHEN similarity IS NULL THEN NULL ELSE round(similarity,6)+0.0 END"


@query("c3_cosine", with_(EDGES, f"SELECT post_id, child_id, {_SIM} AS similarity FROM edges"))
def _(spark, sf):
    e = forest.edge_similarity(thread_nodes(spark, sf), vectors.cosine_expr)
    return tidy(e.select("post_id", "child_id", "similarity"))


@query("c4_pluggable_similarity", with_(EDGES.replace("list_cosine_similarity", "list_dot_product"), f"SELECT post_id, child_id, {_SIM} AS similarity FROM edges"))
def _(spark, sf):
    return tidy(forest.edge_similarity(thread_nodes(spark, sf), sim=vectors.dot).select("post_id", "child_id", "similarity"))


@query("c5_edge_similarity", with_(EDGES, f"SELECT post_id, parent_id, child_id, {_SIM} AS similarity FROM edges"))
def _(spark, sf):
    return tidy(forest.edge_similarity(thread_nodes(spark, sf)))


_DIST = ", ".join([
    "count(similarity) AS count", r("avg(similarity)", "mean"), r("stddev_pop(similarity)", "std"),
    r("min(similarity)", "min"), r("max(similarity)", "max"), r("median(similarity)", "median"),
    *[r(f"quantile_cont(similarity, {q})", n) for n, q in [("p25", .25), ("p75", .75), ("p90", .9), ("p95", .95)]]])


@query("c6_post_similarity_distribution", with_(EDGES, f"SELECT post_id, {_DIST} FROM edges WHERE similarity IS NOT NULL GROUP BY post_id"))
def _(spark, sf):
    return tidy(forest.similarity_distribution(stored(forest.edge_similarity(thread_nodes(spark, sf)))))


@query("c7_overall_similarity_distribution", with_(EDGES, f"SELECT {_DIST} FROM edges WHERE similarity IS NOT NULL"))
def _(spark, sf):
    return tidy(forest.similarity_distribution(stored(forest.edge_similarity(thread_nodes(spark, sf))), by=()))


@query("c7_similarity_summary", with_(EDGES, """SELECT (SELECT count(*) FROM nodes WHERE parent_id IS NULL) AS total_posts,
  count(DISTINCT post_id) AS posts_with_valid_similarities, count(*) AS total_similarity_pairs FROM edges WHERE similarity IS NOT NULL"""))
def _(spark, sf):
    nodes = thread_nodes(spark, sf)
    return forest.similarity_summary(nodes, forest.edge_similarity(nodes))


@query("c8_similarity_variability", with_(EDGES + ", d AS (SELECT avg(similarity) AS m, stddev_pop(similarity) AS s FROM edges WHERE similarity IS NOT NULL GROUP BY post_id)",
    "SELECT count(*) AS posts, " + ", ".join(r(f"{f}({c})", f"{n}_{k}") for c, k in (("m", "mean"), ("s", "std")) for f, n in (("min", "min"), ("max", "max"), ("stddev_pop", "std"))) + " FROM d"))
def _(spark, sf):
    edges = stored(forest.edge_similarity(thread_nodes(spark, sf)))
    return tidy(forest.similarity_variability(forest.similarity_distribution(edges)))


@query("c8_first_posts", with_(EDGES, f"SELECT post_id, count(*) AS count, {r('avg(similarity)','mean')}, {r('stddev_pop(similarity)','std')}, {r('median(similarity)','median')}, {r('min(similarity)','min')}, {r('max(similarity)','max')} FROM edges WHERE similarity IS NOT NULL GROUP BY post_id QUALIFY row_number() OVER (ORDER BY post_id) <= 10"))
def _(spark, sf):
    edges = stored(forest.edge_similarity(thread_nodes(spark, sf)))
    return tidy(forest.similarity_listing(forest.similarity_distribution(edges)))


# ---- forests --------------------------------------------------------------------------------------

@query("d1_prune", with_(pruned_sql(T0), f"SELECT post_id, parent_id, child_id, {_SIM} AS similarity, kept, reason FROM pruned"))
def _(spark, sf):
    p = forest.prune(forest.edge_similarity(thread_nodes(spark, sf)), T0)
    return tidy(p.select("post_id", "parent_id", "child_id", "similarity", "kept", "reason"))


@query("d2_cut_edge_log", with_(pruned_sql(T0), "SELECT post_id, parent_id, child_id, round(similarity_score,6)+0.0 AS similarity_score, threshold, reason FROM log"))
def _(spark, sf):
    return tidy(forest.cut_edge_log(forest.prune(forest.edge_similarity(thread_nodes(spark, sf)), T0)))


def _forest(spark, sf, threshold=T0):
    return forest.grow_forest(thread_nodes(spark, sf), threshold)


def _log(spark, sf, threshold=T0):
    return forest.cut_edge_log(stored(forest.prune(forest.edge_similarity(thread_nodes(spark, sf)), threshold)))


@query("d3_assign_roots", with_(forest_sql(T0), "SELECT post_id, comment_id, parent_id, root_id, dist FROM assigned"))
def _(spark, sf):
    return _forest(spark, sf)[1].select("post_id", "comment_id", "parent_id", "root_id", "dist")


@query("d4_subtrees", with_(forest_sql(T0), "SELECT * FROM trees"))
def _(spark, sf):
    return _forest(spark, sf)[2]


_STATS = """
stats AS (SELECT t.post_id, count(*) AS subtree_count, sum(size)::BIGINT AS total_nodes, avg(size) AS avg_subtree_size,
  max(size) AS max_subtree_size, min(size) AS min_subtree_size, avg(depth) AS avg_depth, max(depth) AS max_depth,
  coalesce(any_value(c.n), 0) AS cut_edges_count
  FROM trees t LEFT JOIN (SELECT post_id, count(*) AS n FROM log GROUP BY ALL) c USING (post_id) GROUP BY t.post_id)"""
_STAT_COLS = f"subtree_count, total_nodes, {r('avg_subtree_size','avg_subtree_size')}, max_subtree_size, min_subtree_size, {r('avg_depth','avg_depth')}, max_depth, cut_edges_count"


@query("d5_forest_stats", with_(forest_sql(T0) + "," + _STATS, f"SELECT post_id, {_STAT_COLS} FROM stats"))
def forest_stats_query(spark, sf):
    edges, _, trees = _forest(spark, sf)
    return tidy(forest.forest_stats(trees, edges))


@query("d6_all_forest_stats", with_(forest_sql(T0) + "," + _STATS, f"""SELECT count(*) AS total_posts, sum(subtree_count)::BIGINT AS total_subtrees,
  sum(total_nodes)::BIGINT AS total_nodes, sum(cut_edges_count)::BIGINT AS total_cut_edges, {r('avg(subtree_count)','avg_subtrees_per_post')},
  {r('avg(total_nodes)','avg_nodes_per_post')}, {r('avg(cut_edges_count)','avg_cut_edges_per_post')} FROM stats"""))
def _(spark, sf):
    edges, _, trees = _forest(spark, sf)
    return tidy(forest.all_forest_stats(forest.forest_stats(trees, edges)))


@query("d7_cut_edge_stats", with_(pruned_sql(T0), f"""SELECT post_id, count(*) AS total_cut_edges, count(*) FILTER (similarity_score >= 0) AS valid_similarity_count,
  {r('avg(similarity_score) FILTER (similarity_score >= 0)','avg_similarity')}, {r('min(similarity_score) FILTER (similarity_score >= 0)','min_similarity')},
  {r('max(similarity_score) FILTER (similarity_score >= 0)','max_similarity')}, {r('stddev_pop(similarity_score) FILTER (similarity_score >= 0)','std_similarity')},
  {r('median(similarity_score) FILTER (similarity_score >= 0)','median_similarity')} FROM log GROUP BY post_id HAVING count(*) FILTER (similarity_score >= 0) > 0"""))
def _(spark, sf):
    return tidy(forest.cut_edge_stats(_log(spark, sf)))


@query("d8_cut_edges_between", with_(pruned_sql(T0), "SELECT post_id, parent_id, child_id, round(similarity_score,6)+0.0 AS similarity_score, threshold, reason FROM log WHERE similarity_score BETWEEN 0 AND 0.03"))
def _(spark, sf):
    return tidy(forest.cut_edges_between(_log(spark, sf), 0.0, 0.03))


@query("d9_cut_edge_histogram", with_(pruned_sql(0.35), f"""SELECT CASE WHEN similarity_score<0.1 THEN '0.0-0.1' WHEN similarity_score<0.2 THEN '0.1-0.2' WHEN similarity_score<0.3 THEN '0.2-0.3'
  WHEN similarity_score<0.4 THEN '0.3-0.4' WHEN similarity_score<0.5 THEN '0.4-0.5' WHEN similarity_score<0.6 THEN '0.5-0.6' WHEN similarity_score<0.7 THEN '0.6-0.7'
  WHEN similarity_score<0.8 THEN '0.7-0.8' WHEN similarity_score<0.9 THEN '0.8-0.9' ELSE '0.9-1.0' END AS bin,
  count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER ()','percentage')} FROM log WHERE similarity_score >= 0 GROUP BY 1"""))
def _(spark, sf):
    return tidy(forest.cut_edge_histogram(_log(spark, sf, 0.35)))


@query("d9_cut_reasons", with_(pruned_sql(T0), f"SELECT reason, count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER ()','percentage')} FROM log GROUP BY 1"))
def _(spark, sf):
    return tidy(forest.cut_reasons(_log(spark, sf)))


_BIN = """CASE WHEN size=1 THEN '1' WHEN size=2 THEN '2-2' WHEN size=3 THEN '3-3' WHEN size<=5 THEN '4-5' WHEN size<=10 THEN '6-10' WHEN size<=20 THEN '11-20'
  WHEN size<=50 THEN '21-50' WHEN size<=99 THEN '51-99' ELSE '100+' END"""
_SIZES = f"""sum(size)::BIGINT AS total_nodes, count(*) AS subtree_count, {r('avg(size)','avg_size')}, max(size) AS max_size, min(size) AS min_size, {r('stddev_pop(size)','std_size')},
  count(*) FILTER (size<=3) AS small_trees, count(*) FILTER (size BETWEEN 4 AND 10) AS medium_trees, count(*) FILTER (size>10) AS large_trees,
  {r('median(size)','median_size')}, {r('quantile_cont(size,0.25)','p25_size')}, {r('quantile_cont(size,0.75)','p75_size')}, {r('quantile_cont(size,0.9)','p90_size')}, {r('quantile_cont(size,0.95)','p95_size')}"""


@query("d10_size_distribution", with_(forest_sql(T0), f"SELECT post_id, {_SIZES} FROM trees GROUP BY post_id"))
def _(spark, sf):
    return tidy(forest.size_distribution(_forest(spark, sf)[2]))


@query("d10_size_histogram", with_(forest_sql(T0), f"SELECT post_id, {_BIN} AS bin, count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER (PARTITION BY post_id)','percentage')} FROM trees GROUP BY 1,2"))
def _(spark, sf):
    return tidy(forest.size_histogram(_forest(spark, sf)[2]))


@query("d10_size_frequencies", with_(forest_sql(T0), f"SELECT size, count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER ()','percentage')} FROM trees GROUP BY size ORDER BY count DESC, size LIMIT 10"))
def _(spark, sf):
    return tidy(forest.size_frequencies(_forest(spark, sf)[2]))


@query("d11_overall_size_distribution", with_(forest_sql(T0), f"SELECT {_SIZES} FROM trees"))
def _(spark, sf):
    return tidy(forest.size_distribution(_forest(spark, sf)[2], by=()))


@query("d11_overall_size_histogram", with_(forest_sql(T0), f"SELECT {_BIN} AS bin, count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER ()','percentage')} FROM trees GROUP BY 1"))
def _(spark, sf):
    return tidy(forest.size_histogram(_forest(spark, sf)[2], by=()))


@query("d12_largest_subtrees", with_(forest_sql(T0), "SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY size DESC, root_id) AS rank FROM trees QUALIFY rank <= 5"))
def _(spark, sf):
    return tidy(forest.largest_subtrees(_forest(spark, sf)[2], 5))


@query("d13_subtrees_between", with_(forest_sql(T0), "SELECT * FROM trees WHERE size BETWEEN 2 AND 4"))
def _(spark, sf):
    return forest.subtrees_between(_forest(spark, sf)[2], 2, 4)


@query("d14_summary_labels", with_(forest_sql(-0.1) + f", d AS (SELECT post_id, {_SIZES} FROM trees GROUP BY post_id)", f"""SELECT post_id, subtree_count, total_nodes,
  CASE WHEN small_trees>=medium_trees AND small_trees>=large_trees THEN 'small' WHEN medium_trees>=large_trees THEN 'medium' ELSE 'large' END AS dominant_category,
  {r('greatest(small_trees,medium_trees,large_trees)*100.0/subtree_count','dominant_percentage')},
  CASE WHEN subtree_count<=1 THEN 'none' WHEN total_nodes/subtree_count>=10 THEN 'low' WHEN total_nodes/subtree_count>=5 THEN 'medium' WHEN total_nodes/subtree_count>=2 THEN 'high' ELSE 'very high' END AS fragmentation_level FROM d"""))
def _(spark, sf):
    return tidy(forest.summary_labels(forest.size_distribution(_forest(spark, sf, -0.1)[2])))


SWEEP = (-0.2, 0.0, 0.05, 0.1)


@query("d15_threshold_sweep", "WITH RECURSIVE " + EDGES.strip() + f""",
ts AS (SELECT unnest([{','.join(map(str, SWEEP))}])::DOUBLE AS threshold),
pruned AS (SELECT *, similarity IS NULL OR similarity >= threshold AS kept FROM edges, ts),
log AS (SELECT * FROM pruned WHERE similarity IS NULL OR NOT kept),
assigned AS (
  SELECT threshold, post_id, comment_id, comment_id AS root_id, 0::BIGINT AS dist FROM nodes, ts WHERE parent_id = post_id
  UNION ALL SELECT threshold, post_id, child_id, child_id, 0 FROM pruned WHERE NOT kept
  UNION ALL SELECT p.threshold, p.post_id, p.child_id, a.root_id, a.dist+1 FROM pruned p JOIN assigned a ON a.threshold=p.threshold AND a.post_id=p.post_id AND a.comment_id=p.parent_id WHERE p.kept),
trees AS (SELECT threshold, post_id, root_id, count(*) AS size, max(dist) AS depth FROM assigned GROUP BY ALL),
stats AS (SELECT t.threshold, t.post_id, count(*) AS subtree_count, sum(size)::BIGINT AS total_nodes, avg(size) AS avg_subtree_size,
  max(size) AS max_subtree_size, min(size) AS min_subtree_size, avg(depth) AS avg_depth, max(depth) AS max_depth, coalesce(any_value(c.n), 0) AS cut_edges_count
  FROM trees t LEFT JOIN (SELECT threshold, post_id, count(*) AS n FROM log GROUP BY ALL) c USING (threshold, post_id) GROUP BY 1,2)
SELECT threshold, post_id, {_STAT_COLS} FROM stats""")
def _(spark, sf):
    return tidy(forest.threshold_sweep(thread_nodes(spark, sf), SWEEP))


@query("d16_sample_by_size", with_(forest_sql(T0) + f""",
g AS (SELECT *, CASE WHEN size<=1 THEN '1' WHEN size=2 THEN '2' WHEN size=3 THEN '3' WHEN size<=5 THEN '4-5' WHEN size<=10 THEN '6-10' WHEN size<=20 THEN '11-20' WHEN size<=50 THEN '21-50' WHEN size<=100 THEN '51-100' ELSE '100+' END AS size_group FROM trees),
k AS (SELECT *, count(*) OVER (PARTITION BY size_group) AS group_total, row_number() OVER (PARTITION BY size_group ORDER BY {hash_sql(42,'post_id','root_id')}, post_id, root_id) AS rk FROM g)""",
    f"SELECT size_group, post_id, root_id, original_parent_id, size, depth, group_total, {r('least(3,group_total)*100.0/group_total','sampling_rate')} FROM k WHERE rk<=3"))
def _(spark, sf):
    return tidy(forest.sample_by_size(stored(_forest(spark, sf)[2]), 3))


@query("d17_before_after", with_(forest_sql(T0) + "," + _STATS, f"""SELECT n.post_id, n.n AS original_nodes, n.n-1 AS original_edges, s.total_nodes AS forest_nodes, s.subtree_count, s.cut_edges_count AS cut_edges,
  n.n-1-s.cut_edges_count AS remaining_edges, {r('s.cut_edges_count*100.0/nullif(n.n-1,0)','cut_percentage')}
  FROM (SELECT post_id, count(*) AS n FROM nodes GROUP BY 1) n JOIN stats s USING (post_id)"""))
def _(spark, sf):
    nodes = thread_nodes(spark, sf)
    edges, _, trees = forest.grow_forest(nodes, T0)
    return tidy(forest.before_after(nodes, trees, edges))
