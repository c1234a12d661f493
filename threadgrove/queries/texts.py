"""Checked queries: text rules, vocabulary, training pairs, negatives, batches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadgrove.functions import text
from threadgrove.functions.hashing import portable_hash
from threadgrove.operators import forest, pairs, scoring, vocabulary
from threadgrove.queries.base import NODES, class_exp_sql, class_probs, forest_sql, hash_sql, query, r, table, thread_nodes, tidy, with_
from threadgrove.session import stored
from threadgrove.sources.tables import normalise_pairs

T1 = -0.05
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean_sql(x: str) -> str:
    stop = "(?i)" + "|".join(text.STOP_LIST)
    return (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x},''), '\\[.*?\\]', '', 'g'), "
            f"'@[^{SPACE}]+[{SPACE}]?', '', 'g'), '{stop}', '', 'g'), '\\A[{SPACE}]+|[{SPACE}]+\\z', '', 'g')")


def _marked(spark, sf):
    """Documents and conversation turns with a bracketed mark, a mention and a brand word added in front."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    chat = table(spark, sf, "conversations").select(F.concat_ws("_", F.lit("t"), "conv_id", "turn").alias("id"), "text")
    return docs.unionByName(chat).select("id", F.concat(F.lit(" [x]@user Oppo 小米"), "text").alias("content"))


_MARKED = """marked AS (
  SELECT 'd'||doc_id AS id, ' [x]@user Oppo 小米'||text AS content FROM documents
  UNION ALL SELECT concat_ws('_','t',conv_id,turn), ' [x]@user Oppo 小米'||text FROM conversations)"""


@query("e1_clean_text", with_(_MARKED, f"SELECT id, md5({clean_sql('content')}) AS digest, length({clean_sql('content')}) AS n FROM marked"))
def _(spark, sf):
    c = text.clean_text("content")
    return tidy(_marked(spark, sf).select("id", F.md5(c).alias("digest"), F.length(c).alias("n")))


@query("e2_text_or_default", """SELECT page_id, coalesce(nullif(regexp_extract(html,'<title>([^<]*)</title>',1),''),'<unk>') AS title FROM pages""")
def _(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", text.text_or(title).alias("title"))


@query("e3_min_length", f"SELECT lang, count(*) AS kept FROM documents WHERE length({clean_sql('text')}) >= 40 GROUP BY lang")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(text.long_enough(text.clean_text("text"), 40)).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))


@query("e4_preview", "SELECT doc_id, CASE WHEN length(text)>100 THEN substr(text,1,100)||'...' ELSE text END AS preview FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.preview("text").alias("preview"))


_TOKENS = """tokens AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '')) AS token FROM documents),
counts AS (SELECT token, count(*) AS count FROM tokens GROUP BY 1 HAVING count(*) >= 2),
vocab AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, """ + hash_sql(0, "token") + """, token) + 1 AS id FROM counts)"""


def _vocab(spark, sf):
    return vocabulary.vocabulary(table(spark, sf, "documents"), min_freq=2, text="text")


@query("e5_vocabulary", with_(_TOKENS, "SELECT token, count, id FROM vocab UNION ALL SELECT '<pad>', 0, 0 UNION ALL SELECT '<unk>', 0, 1"))
def _(spark, sf):
    return vocabulary.special_tokens(_vocab(spark, sf))


def _digest(ids: str, mask: str) -> Column:
    """md5 of the comma-joined ids. A tail of fill that is all zeros is written as such, not number by number."""
    n, zero = F.size(ids), F.array_position(mask, F.lit(0).cast("bigint"))
    used = F.when(zero > 0, zero - 1).otherwise(n).cast("int")
    head, tail = F.slice(ids, F.lit(1), used), F.slice(ids, used + 1, n - used)
    plain = (F.array_min(tail) == 0) & (F.array_max(tail) == 0)
    fill = F.when(plain, F.concat(F.repeat(F.lit("0,"), n - used - 1), F.lit("0"))).otherwise(F.array_join(tail, ","))
    return F.md5(F.concat_ws(",", F.when(used > 0, F.array_join(head, ",")), F.when(n > used, fill)))


def _used(mask: str) -> Column:
    """How many ones the mask begins with."""
    zero = F.array_position(mask, F.lit(0).cast("bigint"))
    return F.when(zero > 0, zero - 1).otherwise(F.size(mask)).cast("bigint")


@query("e6_encode_tokens", with_(_TOKENS + """,
lists AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS p FROM lists),
ids AS (SELECT doc_id, list(coalesce(v.id,1) ORDER BY p) AS ids FROM placed LEFT JOIN vocab v USING (token) GROUP BY 1),
w AS (SELECT max(len(ids)) AS w FROM ids)""",
    """SELECT l.doc_id, md5(array_to_string(list_concat(coalesce(ids,[]), list_resize([]::BIGINT[], (SELECT w FROM w) - coalesce(len(ids),0), 0)), ',')) AS ids,
  coalesce(len(ids),0)::BIGINT AS used FROM lists l LEFT JOIN ids USING (doc_id)"""))
def _(spark, sf):
    coded = vocabulary.encode_tokens(table(spark, sf, "documents"), stored(_vocab(spark, sf)), "doc_id", text="text",
                                     max_len=None, pad="longest")
    return tidy(coded.select("doc_id", _digest("input_ids", "attention_mask").alias("ids"), _used("attention_mask").alias("used")))


@query("e6_encode_tokens_by_batch", with_(_TOKENS + """,
lists AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b]+'), lambda w: w <> '') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS p FROM lists),
ids AS (SELECT doc_id, list(coalesce(v.id,1) ORDER BY p) AS ids FROM placed LEFT JOIN vocab v USING (token) GROUP BY 1),
w AS (SELECT doc_id // 16 AS b, max(coalesce(len(ids),0)) AS w FROM lists LEFT JOIN ids USING (doc_id) GROUP BY 1)""",
    """SELECT l.doc_id, md5(array_to_string(list_concat(coalesce(ids,[]), list_resize([]::BIGINT[], w.w - coalesce(len(ids),0), 0)), ',')) AS ids,
  w.w::BIGINT AS width FROM lists l LEFT JOIN ids USING (doc_id) JOIN w ON w.b = l.doc_id // 16"""))
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("batch", F.floor(F.col("doc_id") / 16))
    coded = vocabulary.encode_tokens(docs, stored(_vocab(spark, sf)), "doc_id", text="text", max_len=None, pad="longest", batch="batch")
    return tidy(coded.select("doc_id", _digest("input_ids", "attention_mask").alias("ids"), F.size("input_ids").cast("bigint").alias("width")))


@query("e7_fraction_of_key", f"""SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END)::DOUBLE AS fraction,
  (CASE o_orderstatus WHEN 'F' THEN 0.75 END)::DOUBLE AS threshold FROM orders""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    key = F.when(s == "F", "bert_frac1.0").when(s == "O", "cnn_frac0.5").otherwise("plain")
    path = F.when(s == "F", F.lit("out/sim_0.75/pairs")).otherwise("out/pairs")
    return table(spark, sf, "orders").select("o_orderkey", text.fraction_of(key).alias("fraction"),
                                             text.threshold_of_path(path).alias("threshold"))


# ---- pairs ----------------------------------------------------------------------------------------

def _grown(spark, sf):
    nodes = thread_nodes(spark, sf)
    return (nodes, *forest.grow_forest(nodes, T1))


_CLEAN = forest_sql(T1) + f""",
clean AS (SELECT *, {clean_sql('content')} AS txt FROM nodes WHERE parent_id IS NOT NULL AND length({clean_sql('content')}) >= 5)"""
_PC = _CLEAN + """,
pc AS (SELECT p.post_id, p.parent_id, p.child_id, a.txt AS anchor_content, c.txt AS positive_content, p.similarity
  FROM pruned p JOIN clean a ON a.post_id=p.post_id AND a.comment_id=p.parent_id JOIN clean c ON c.post_id=p.post_id AND c.comment_id=p.child_id
  WHERE p.kept AND p.similarity IS NOT NULL)"""
_BIG = """,
big AS (SELECT c.post_id, c.comment_id, c.txt, c.seq, c.embedding, t.root_id, t.size FROM clean c JOIN assigned a USING (post_id, comment_id) JOIN trees t USING (post_id, root_id) WHERE t.size >= {n})"""


@query("f1_parent_child_pairs", with_(_PC, f"SELECT post_id, parent_id, child_id, anchor_content, positive_content, {r('similarity','similarity')} FROM pc"))
def _(spark, sf):
    return tidy(pairs.parent_child_pairs(*_grown(spark, sf)))


@query("f1_pairs_of_large_subtrees", with_(_PC, f"SELECT pc.post_id, pc.parent_id, pc.child_id, {r('similarity','similarity')} FROM pc JOIN assigned a ON a.post_id=pc.post_id AND a.comment_id=pc.child_id JOIN trees t ON t.post_id=a.post_id AND t.root_id=a.root_id WHERE t.size >= 4"))
def _(spark, sf):
    return tidy(pairs.parent_child_pairs(*_grown(spark, sf), min_size=4).select("post_id", "parent_id", "child_id", "similarity"))


@query("f2_node_center_pairs", with_(_CLEAN + _BIG.format(n=3), "SELECT post_id, root_id, comment_id AS node_id, txt AS anchor_content, size AS subtree_size, 'node_center' AS pair_type FROM big"))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    return pairs.node_center_pairs(nodes, assigned, trees)


_DOT = "list_sum(list_transform(range(1, 11), lambda i: pa[i]*pb[i]))"


@query("f2_node_center_scores", with_(_CLEAN + _BIG.format(n=3) + f""",
v AS (SELECT post_id, root_id, unnest(embedding) AS x, generate_subscripts(embedding,1)-1 AS pos FROM big WHERE embedding IS NOT NULL),
cen AS (SELECT post_id, root_id, list(x ORDER BY pos) AS c FROM (SELECT post_id, root_id, pos, avg(x) AS x FROM v GROUP BY ALL) GROUP BY ALL),
ex AS (SELECT b.post_id, b.root_id, b.comment_id, b.size, {class_exp_sql('b.embedding')} AS ea, {class_exp_sql('cen.c')} AS eb FROM big b LEFT JOIN cen USING (post_id, root_id)),
pr AS (SELECT *, list_transform(ea, lambda x: x/list_sum(ea)) AS pa, list_transform(eb, lambda x: x/list_sum(eb)) AS pb FROM ex)""",
    f"SELECT post_id, root_id, comment_id AS node_id, size AS subtree_size, 'dataset2' AS dataset_type, {r(f'CASE WHEN pa IS NULL OR pb IS NULL THEN 0 ELSE {_DOT} END','consistency_score')} FROM pr"))
def _(spark, sf):
    """From threads to scores: node/centre pairs, normalised by key, each centre classified once."""
    nodes, _e, assigned, trees = _grown(spark, sf)
    members = stored(pairs.center_members(nodes, assigned, trees))
    rows = stored(pairs.with_sample_index(stored(pairs.node_center_pairs(nodes, assigned, trees)), ["post_id", "node_id"]))
    named = rows.select("sample_index", "node_id")
    kept = normalise_pairs(rows).join(named, "sample_index")
    node_probs = nodes.select("post_id", F.col("comment_id").alias("node_id"), class_probs("embedding").alias("probs"))
    centers = pairs.center_vectors(nodes, members)
    center_probs = centers.select("post_id", "root_id", class_probs("center").alias("probs"))
    out = scoring.node_center_scores(kept, node_probs, center_probs, "simple_dot_product")
    return tidy(out.select("post_id", "root_id", "node_id", "subtree_size", "dataset_type", "consistency_score"))


@query("f2_center_text_chunks", with_(_CLEAN + _BIG.format(n=3) + f""",
k AS (SELECT *, (row_number() OVER (PARTITION BY post_id, root_id ORDER BY {hash_sql(42,'post_id','comment_id')}, comment_id) - 1)//3 AS chunk FROM big)""",
    "SELECT post_id, root_id, chunk, count(*) AS texts, md5(string_agg(txt, '|' ORDER BY seq)) AS digest FROM k GROUP BY 1,2,3"))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    chunks = pairs.center_text_chunks(pairs.center_members(nodes, assigned, trees), 3)
    return tidy(chunks.select("post_id", "root_id", "chunk", F.size("positive_content_list").alias("texts"),
                              F.md5(F.array_join("positive_content_list", "|")).alias("digest")))


@query("c2_center_vectors", with_(_CLEAN + _BIG.format(n=3) + """,
v AS (SELECT post_id, root_id, unnest(embedding) AS x, generate_subscripts(embedding,1)-1 AS pos FROM big WHERE embedding IS NOT NULL)""",
    f"SELECT post_id, root_id, pos, {r('avg(x)','value')} FROM v GROUP BY 1,2,3"))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    centers = pairs.center_vectors(nodes, pairs.center_members(nodes, assigned, trees))
    return tidy(centers.select("post_id", "root_id", F.posexplode("center").alias("pos", "value")))


@query("f3_single_texts", with_(_CLEAN + _BIG.format(n=2) + """,
k AS (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY seq) AS rk FROM big)""", "SELECT txt AS content, post_id, comment_id FROM k WHERE rk=1"))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    return pairs.single_texts(nodes, assigned, trees)


@query("f4_cap_per_post", with_(_PC + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {hash_sql(42,'post_id','child_id')}, child_id) AS rk FROM pc)""", "SELECT post_id, parent_id, child_id FROM k WHERE rk <= 3"))
def _(spark, sf):
    return pairs.parent_child_pairs(*_grown(spark, sf), per_post=3).select("post_id", "parent_id", "child_id")


@query("f4_global_cap", with_(_CLEAN + _BIG.format(n=2) + f""",
k AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42,'post_id','comment_id')}, post_id, comment_id) AS rk FROM big)""", "SELECT post_id, comment_id FROM k WHERE rk <= (SELECT 2000)"))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    return pairs.single_texts(nodes, assigned, trees, remove_duplicates=False, max_samples=2000).select("post_id", "comment_id")


_POOL = NODES + f""",
pool AS (SELECT post_id, comment_id, content, row_number() OVER (PARTITION BY post_id ORDER BY {hash_sql(42,'post_id','comment_id')}, comment_id) - 1 AS pool_index
  FROM nodes WHERE parent_id IS NOT NULL AND length(content) > 0),
posts AS (SELECT post_id, n, row_number() OVER (ORDER BY {hash_sql(42,'post_id')}, post_id) - 1 AS idx FROM (SELECT post_id, count(*) AS n FROM pool GROUP BY 1))"""


@query("f5_negative_pool", with_(_POOL, "SELECT post_id, comment_id, content, pool_index FROM pool"))
def _(spark, sf):
    return pairs.negative_pool(thread_nodes(spark, sf))


@query("f6_cross_thread_negatives", with_(_POOL + f""",
slots AS (SELECT seq AS sample_index, post_id, unnest([0,1,2]) AS slot FROM nodes WHERE parent_id IS NOT NULL AND parent_id <> post_id),
d AS (SELECT s.*, o.idx AS own, {hash_sql('42:post','sample_index','slot')} % ((SELECT count(*) FROM posts) - 1) AS draw FROM slots s JOIN posts o USING (post_id)),
c AS (SELECT d.*, t.post_id AS negative_post_id, {hash_sql('42:text','sample_index','slot')} % t.n AS pi FROM d JOIN posts t ON t.idx = draw + CASE WHEN draw >= own THEN 1 ELSE 0 END)""",
    """SELECT c.sample_index, c.post_id, c.slot::BIGINT AS slot, c.negative_post_id, p.comment_id AS negative_id, p.content AS negative_content
  FROM c JOIN pool p ON p.post_id = c.negative_post_id AND p.pool_index = c.pi"""))
def _(spark, sf):
    nodes = thread_nodes(spark, sf)
    replies = nodes.filter(F.col("parent_id") != F.col("post_id")).select(F.col("seq").alias("sample_index"), "post_id")
    return tidy(pairs.cross_thread_negatives(replies, nodes, n=3))


_BATCH = _PC + f""",
b AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42,'post_id','child_id')}, post_id, child_id) - 1 AS rn, count(*) OVER () AS total FROM pc),
batched AS (SELECT *, rn//8 AS batch_id, rn%8 AS position, least(8, total - (rn//8)*8) AS batch_size FROM b)"""


@query("f7_batches", with_(_BATCH, "SELECT batch_id, count(*) AS n, md5(string_agg(anchor_content, '|' ORDER BY position)) AS anchors, md5(string_agg(positive_content, '|' ORDER BY position)) AS positives, string_agg(post_id, ',' ORDER BY position) AS post_ids FROM batched GROUP BY 1"))
def _(spark, sf):
    b = pairs.to_batches(pairs.parent_child_pairs(*_grown(spark, sf)), 8, ["post_id", "child_id"])
    return tidy(b.select("batch_id", F.size("anchor_texts").alias("n"), F.md5(F.array_join("anchor_texts", "|")).alias("anchors"),
                         F.md5(F.array_join("positive_texts", "|")).alias("positives"), F.array_join("post_ids", ",").alias("post_ids")))


@query("f8_hybrid", with_(_BATCH + """,
h AS (SELECT * FROM batched WHERE position < floor(batch_size*0.5)),
s AS (SELECT batch_id, anchor_content AS t, position AS o FROM h UNION ALL SELECT batch_id, positive_content, batch_size + position FROM h),
u AS (SELECT batch_id, t, min(o) AS o FROM s WHERE trim(t) <> '' GROUP BY 1,2)""", """SELECT batch_id, 'single' AS part, o::BIGINT AS place, t AS anchor_content, t AS positive_content FROM u
  UNION ALL SELECT batch_id, 'pair', position, anchor_content, positive_content FROM batched WHERE position >= floor(batch_size*0.5)"""))
def _(spark, sf):
    b = pairs.batch_rows(pairs.parent_child_pairs(*_grown(spark, sf)), 8, ["post_id", "child_id"])
    return pairs.hybrid(b, 0.5)


@query("f9_text_summary", with_(_CLEAN + _BIG.format(n=2), f"""SELECT (SELECT count(*) FROM trees WHERE size>=2) AS subtrees, (SELECT count(*) FROM big) AS texts_before, count(*) AS texts_after,
  {r('((SELECT count(*) FROM big) - count(*))*100.0/(SELECT count(*) FROM big)','dedup_percentage')}, {r('avg(length(txt))','mean_length')}, min(length(txt)) AS min_length, max(length(txt)) AS max_length FROM (SELECT DISTINCT txt FROM big)"""))
def _(spark, sf):
    nodes, _e, assigned, trees = _grown(spark, sf)
    return tidy(pairs.text_summary(nodes, assigned, trees))


@query("threads_to_pairs", with_(_PC, "SELECT post_id, parent_id, child_id, anchor_content, positive_content FROM pc"))
def _(spark, sf):
    """From raw posts and comments to pairs in one go."""
    from threadgrove.plans.curation import threads_to_pairs
    from threadgrove.queries.threads import _raw_comments, _raw_posts

    vecs = thread_nodes(spark, sf).select("post_id", "comment_id", "embedding")
    out = threads_to_pairs(_raw_posts(spark, sf), _raw_comments(spark, sf), vecs, T1)
    return out.select("post_id", "parent_id", "child_id", "anchor_content", "positive_content")
