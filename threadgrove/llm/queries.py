"""One query per operator over its whole table, with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadgrove.llm import (conversation_trie, decontamination, fingerprint, language_id, mixing, packing, periodic, quality, secrets,
                             simhash, suffix, topk, toxicity)
from threadgrove.llm.fingerprint import bound
from threadgrove.operators.skew import lookup
from threadgrove.queries.base import hash_sql
from threadgrove.session import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SQL["op1_exact_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

SQL["op7_curriculum_mix"] = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         {hash_sql("mix", "coalesce(doc_id::VARCHAR, '')", "coalesce(source, '')")} AS h FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goals AS (
  SELECT source, source_size, rank, round(least(cap, coalesce(
    (SELECT arg_min(level, [cap / weight, rank]) FROM levels WHERE level <= cap / weight) * weight, cap)), 6) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS goal,
         [0.0::DOUBLE, 0.5, -0.5][g.rank % 3 + 1] AS slope,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS first
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, least(greatest(goal - first, 0), size) AS once, least(greatest(goal - first - source_size, 0), size) AS twice FROM placed),
shares AS (SELECT *, least((first::DOUBLE + once / 2.0::DOUBLE) / nullif(target, 0), 1.0::DOUBLE) AS u FROM taken)
SELECT doc_id, size, source_size, target, (once + twice)::BIGINT AS taken,
       CASE WHEN once > 0 THEN round(CASE WHEN slope = 0 THEN u
         ELSE (sqrt((1.0 - slope) * (1.0 - slope) + slope * u * 4) - (1.0 - slope)) / (slope * 2) END, 9) END AS position
FROM shares"""

# crc32 of a decimal number, byte by byte with a table that is made from the polynomial
SQL["op11_conversation_trie"] = """
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, md5(coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, max(k) AS n, (conv_id::VARCHAR) AS digits FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(list_reduce([4294967295] || list_transform(range(1, len(digits) + 1), lambda i: ord(digits[i])::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM ids, crc_table),
members AS (
  SELECT m.*, least(m.h, coalesce(b.n, 0)) AS heads FROM hashed m LEFT JOIN ids b ON b.conv_id = m.base),
paths AS (
  SELECT m.conv_id, t.k AS depth, role || ':' || digest AS turn, words FROM members m JOIN turns t ON t.conv_id = m.base AND t.k <= m.h
  UNION ALL
  SELECT m.conv_id, t.k - m.h + m.heads, role || ':' || digest, words FROM members m JOIN turns t ON t.conv_id = m.conv_id AND t.k > m.h),
keyed AS (
  SELECT conv_id, depth, words, string_agg(turn, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM paths
  UNION ALL SELECT conv_id, 0, 0, '' FROM members),
placed AS (
  SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM keyed),
nodes AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS own, count(*) = count(*) FILTER (ends) AS leaf,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ended
  FROM placed GROUP BY node, depth),
above AS (
  SELECT p.node AS top, p.depth AS top_depth, n.depth, n.own, n.leaf FROM nodes n JOIN placed p ON p.conv_id = n.node AND p.depth <= n.depth),
totals AS (
  SELECT top, top_depth, sum(own) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (depth = top_depth + 1) AS children
  FROM above GROUP BY top, top_depth)
SELECT n.node AS conv_id, n.depth::BIGINT AS depth, p.node AS parent_conv_id, n_convs::BIGINT AS n_convs, children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256
FROM nodes n JOIN totals t ON t.top = n.node AND t.top_depth = n.depth
LEFT JOIN placed p ON p.conv_id = n.node AND p.depth = n.depth - 1"""

SQL["op12_benchmark_decontamination"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS win FROM (
    SELECT item, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size),
hits AS (SELECT a.r, a.i, a.size, h.item FROM starts a JOIN windows h ON h.size = a.size AND h.win = list_slice(a.w, a.i, a.i + a.size - 1)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_exact_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op2_language_id(spark, sf):
    documents = table(spark, sf, "documents")
    return language_id.identify_languages(documents, language_id.train(documents))


@query
def op3_dp_packing(spark, sf):
    packed = packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_multiset_fingerprints(spark, sf):
    return fingerprint.fingerprint_documents(table(spark, sf, "documents"))


@query
def op5_secret_forest(spark, sf):
    documents = table(spark, sf, "documents")
    return secrets.scan(documents, *secrets.fitted(documents))


@query
def op6_nbsvm_quality(spark, sf):
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_curriculum_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query
def op8_toxicity_neighbours(spark, sf):
    documents = table(spark, sf, "documents")
    return toxicity.score_toxicity(documents, toxicity.toxicity_index(documents, table(spark, sf, "labels")))


@query
def op9_simhash_gray_index(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op10_difference_cover_dedup(spark, sf):
    found = suffix.repeated_substrings(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_conversation_trie(spark, sf):
    return conversation_trie.trie(*rebuilt(conversation_trie.numbered(table(spark, sf, "conversations"))))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c starts with the first h turns of conversation c - c % 20, h = crc32(c) % 4, and goes on with its own
    turns after its first h; turns of the result, and all conversation ids."""
    conv = F.col("conv_id")
    counts = stored(turns.groupBy("conv_id").agg(F.max("depth").alias("n")))
    members = stored(
        counts.select("conv_id", (conv - conv % 20).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int").alias("h"))
        .join(counts.select(conv.alias("base"), F.col("n").alias("base_n")), "base", "left")
        .select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("heads")))
    first = turns.filter("depth <= 3").withColumnRenamed("conv_id", "base")
    heads = members.join(first, "base").filter("depth <= h").select("conv_id", "depth", "role", "digest", "words")
    own = lookup(turns, members.select("conv_id", "h", "heads"), ["conv_id"], counts=counts.withColumnRenamed("n", "_n"))
    own = own.filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("heads")).alias("depth"), "role", "digest", "words")
    return heads.unionAll(own), members.select("conv_id")


@query
def op12_benchmark_decontamination(spark, sf):
    found = decontamination.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Documents with crc32(doc_id) % 10 = 0 repeat a stretch of their words from word a on, with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        return F.when(n > 0, bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(
            F.transform(w, lambda v, i: F.when(i < x["a"], v).otherwise(F.get(w, x["a"] + (i - x["a"]) % x["p"]))), " ")))

    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return documents.select("doc_id", F.when(h % 10 == 0, bound(words, planted)).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf):
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("x", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"),
        (-F.col("x.period")).alias("period"), F.floor(F.col("x.length") * 1000 / -F.col("x.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
