"""Checked queries: files written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadgrove.operators import scoring
from threadgrove.plans import rounds
from threadgrove.queries.base import NODES, query, r, table, tidy, with_
from threadgrove.queries.scores import _scored, _slim, noisy_sql, scored_sql
from threadgrove.queries.texts import _CLEAN, _grown, _PC
from threadgrove.queries.threads import _RAW_POSTS, _raw_comments, _raw_posts
from threadgrove.sources import embedding_store, enhanced, tables
from threadgrove.session import shared_dir, stored


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_thread_scan", with_(NODES + "," + _RAW_POSTS, """SELECT note_id AS id, md5(content) AS digest, nullif(title,'') AS title, NULL AS parent_comment_id, NULL::BIGINT AS seq FROM raw_posts
  UNION ALL SELECT comment_id, md5(content), NULL, CASE WHEN parent_id=post_id THEN '0' ELSE parent_id END, seq FROM nodes WHERE parent_id IS NOT NULL"""))
def _(spark, sf):
    p, c = _path(spark, "posts"), _path(spark, "comments")
    tables.write_csv(_raw_posts(spark, sf), p)
    tables.write_csv(_raw_comments(spark, sf).select("comment_id", "note_id", "parent_comment_id", "content", "seq"), c)
    posts, comments = tables.read_threads(spark, p, c)
    none = F.lit(None)
    return posts.select(F.col("note_id").alias("id"), F.md5("content").alias("digest"), "title", none.cast("string").alias("parent_comment_id"),
                        none.cast("bigint").alias("seq")).unionByName(
        comments.select(F.col("comment_id").alias("id"), F.md5("content").alias("digest"), none.cast("string").alias("title"), "parent_comment_id", "seq"))


@query("a2_labelled_scan", """SELECT part, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'train' AS part, quality::VARCHAR AS label, text FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'test', role, text FROM conversations) GROUP BY 1,2""")
def _(spark, sf):
    a, b = _path(spark, "train"), _path(spark, "test")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    tables.write_csv(docs.select(F.col("text").alias("content"), F.col("quality").cast("string").alias("label")), a)
    tables.write_csv(table(spark, sf, "conversations").select(F.col("text").alias("content"), F.col("role").alias("label")), b)
    train, test = tables.read_labelled(spark, a, b)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).cast("bigint").alias("chars"))


def _pair_rows(spark, sf):
    """Documents as single texts, conversation turns as parent/child or node/centre pairs."""
    docs = table(spark, sf, "documents").select(
        (F.col("doc_id") * 2).alias("sample_index"), F.lit("simcse_single_text").alias("pair_type"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("anchor_content"), F.lit(None).cast("string").alias("positive_content"), F.lit(None).cast("array<string>").alias("positive_content_list"))
    user = F.col("role") == "user"
    chat = table(spark, sf, "conversations").select(
        ((F.col("conv_id") * 100 + F.col("turn")) * 2 + 1).alias("sample_index"), F.when(user, "parent_child").otherwise("node_center").alias("pair_type"),
        F.lit(None).cast("string").alias("content"), F.col("role").alias("anchor_content"), F.when(user, F.col("text")).alias("positive_content"),
        F.when(~user, F.split("text", "\n")).alias("positive_content_list"))
    return docs.unionByName(chat)


_NORM = """SELECT doc_id*2 AS sample_index, 'simcse' AS dataset_type, md5(text) AS anchor, md5(text) AS positive, NULL::BIGINT AS subtree_size FROM documents WHERE text <> ''
  UNION ALL SELECT (conv_id*100+turn)*2+1, CASE WHEN role='user' THEN 'dataset1' ELSE 'dataset2' END, md5(role), md5(CASE WHEN role='user' THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: x<>''),' ') END),
  CASE WHEN role<>'user' THEN len(string_split(text, chr(10)))::BIGINT END FROM conversations WHERE role='user' OR trim(text)<>''"""


@query("a3_pair_scan", _NORM)
def _(spark, sf):
    """Both layouts: half of the rows inside documents with a `samples` array, the other half as plain rows."""
    rows = _pair_rows(spark, sf)
    nested, flat = _path(spark, "nested"), _path(spark, "flat")
    single = F.col("pair_type") == "simcse_single_text"
    grouped = rows.filter(~single).groupBy(F.shiftright("sample_index", 6).alias("doc")).agg(F.collect_list(F.struct(*rows.columns)).alias("samples"))
    grouped.write.parquet(nested)
    rows.filter(single).write.parquet(flat)
    both = tables.read_pairs(spark, nested).unionByName(tables.read_pairs(spark, flat))
    n = tables.normalise_pairs(both)
    return n.select("sample_index", "dataset_type", F.md5("anchor_content").alias("anchor"), F.md5("positive_content").alias("positive"), "subtree_size")


@query("a4_normalise_pairs", _NORM)
def _(spark, sf):
    n = tables.normalise_pairs(_pair_rows(spark, sf))
    return n.select("sample_index", "dataset_type", F.md5("anchor_content").alias("anchor"), F.md5("positive_content").alias("positive"), "subtree_size")


@query("a6_enhanced_sink", with_(noisy_sql(0.3), f"""SELECT 'main' AS variant, sample_index, {r('s','consistency_score')}, true AS trained_1, src AS noise_source_index FROM (SELECT sample_index, s, NULL::BIGINT AS src FROM scored)
  UNION ALL SELECT 'noise_eval', sample_index, {r('s')}, true, src FROM noisy"""))
def _(spark, sf):
    path = _path(spark, "enhanced")
    scored = stored(_scored(spark, sf, "cosine_similarity"))
    first = rounds.append_history(scored.withColumn("sample_weight", F.lit(1.0)), 1, "threshold", 0.0)
    enhanced.write_enhanced(scoring.inject_noise(scored, 0.0), path, 2, first)
    enhanced.write_enhanced(scoring.inject_noise(scored, 0.3), path, 2, first, "noise_eval")
    return tidy(spark.read.parquet(path).select("variant", "sample_index", "consistency_score", F.col("training_rounds")["round_1"].alias("trained_1"),
                                                F.col("noise.source_index").alias("noise_source_index")))


@query("a7_pair_sink", with_(_PC, "SELECT 'comment_reply' AS strategy, -0.05::DOUBLE AS threshold, post_id, child_id, md5(anchor_content) AS anchor FROM pc"))
def _(spark, sf):
    from threadgrove.operators import pairs
    path = _path(spark, "pairs")
    found = pairs.parent_child_pairs(*_grown(spark, sf))
    for _again in range(2):  # writing a partition twice leaves it once
        tables.write_pairs(found, path, "comment_reply", -0.05)
    return spark.read.parquet(path).select("strategy", F.col("threshold").cast("double").alias("threshold"), "post_id", "child_id", F.md5("anchor_content").alias("anchor"))


def vowel_model():
    """A stand-in encoder that SQL can follow: how often each of five letters occurs."""
    import numpy as np

    def run(texts):
        return np.array([[t.count(c) for c in "aeiou"] for t in texts], dtype="float32")

    return run


_VOWELS = ", ".join(f"(length(t)-length(replace(t,'{c}','')))::DOUBLE AS {c}" for c in "aeiou")


@query("a8_embedding_store", f"SELECT id, {_VOWELS} FROM (SELECT 'd'||doc_id AS id, text AS t FROM documents UNION ALL SELECT concat_ws('_','t',conv_id,turn), text FROM conversations)")
def _(spark, sf):
    """Documents first; then documents and turns, of which only the turns are still to be embedded."""
    path = _path(spark, "store")
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"))
    chat = table(spark, sf, "conversations").select(F.concat_ws("_", F.lit("t"), "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    embedding_store.add_embeddings(docs, path, "vowels", vowel_model)
    out = embedding_store.add_embeddings(docs.unionByName(chat), path, "vowels", vowel_model)
    return out.select("id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("aeiou")])


@query("a8_missing_texts", "SELECT md5(text) AS text_key FROM conversations GROUP BY text HAVING text NOT IN (SELECT text FROM documents)")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("vowels").alias("encoder"), F.md5("text").alias("text_key"))
    return embedding_store.missing_texts(table(spark, sf, "conversations").withColumnRenamed("text", "content"), docs, "vowels").select("text_key")


@query("c1_batch_embed", f"SELECT page_id, {_VOWELS} FROM (SELECT page_id, coalesce(nullif(html,''),'<empty_text_placeholder>') AS t FROM pages)")
def _(spark, sf):
    out = embedding_store.embed(table(spark, sf, "pages"), vowel_model, "html")
    return out.select("page_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("aeiou")])


@query("a9_report_sink", with_(scored_sql("cosine_similarity"), "SELECT category, count(*) AS count, 'csv' AS kind FROM (SELECT CASE WHEN s>=0 AND s<0.2 THEN 'very_low' WHEN s<0.4 THEN 'low' WHEN s<0.6 THEN 'medium' WHEN s<0.8 THEN 'high' ELSE 'very_high' END AS category FROM scored) GROUP BY 1 UNION ALL SELECT category, count(*), 'json' FROM (SELECT CASE WHEN s>=0 AND s<0.2 THEN 'very_low' WHEN s<0.4 THEN 'low' WHEN s<0.6 THEN 'medium' WHEN s<0.8 THEN 'high' ELSE 'very_high' END AS category FROM scored) GROUP BY 1"))
def _(spark, sf):
    counts = scoring.review_counts(_slim(spark, sf, "cosine_similarity"))
    a, b = _path(spark, "report"), _path(spark, "report")
    tables.write_report(counts, a, "csv", single_file=True)
    tables.write_report(counts, b, "json", single_file=True)
    schema = "category string, count bigint"
    return (spark.read.schema(schema).options(**tables.CSV_OPTIONS).csv(a).withColumn("kind", F.lit("csv"))
            .unionByName(spark.read.schema(schema).json(b).withColumn("kind", F.lit("json"))))
