"""Checked queries: consistency, noise, weights, history, losses, rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadgrove.functions import vectors
from threadgrove.functions.consistency import METHODS, consistency
from threadgrove.operators import infonce, pairs as pair_ops, scoring, weights
from threadgrove.plans import rounds
from threadgrove.queries.base import EDGES, PAIRS, PROBS, hash_sql, pairs_with_probs, probabilities, query, r, table, text_classes, text_exp_sql, thread_nodes, tidy, with_
from threadgrove.session import shared_dir, stored

_ENTROPY = "-list_sum(list_transform({p}, lambda x: (x+1e-8)*ln(x+1e-8)))"
_P, _Q = "anchor_probs", "positive_probs"


def _conf(p):
    return f"(1 - ({_ENTROPY.format(p=p)})/ln(len({p})))"


SCORE_SQL = {
    "confidence_weighted_dot_product": f"list_dot_product({_P},{_Q})*{_conf(_P)}*{_conf(_Q)}",
    "kl_divergence": f"exp(-list_sum(list_transform(list_zip({_P},{_Q}), lambda x: (x[1]-x[2])*(ln(x[1]+1e-8)-ln(x[2]+1e-8))))/2)",
    "cosine_similarity": f"(list_cosine_similarity({_P},{_Q})+1)/2",
    "simple_dot_product": f"list_dot_product({_P},{_Q})",
    "prediction_agreement": f"CASE WHEN list_position({_P},list_max({_P}))=list_position({_Q},list_max({_Q})) THEN least(list_max({_P}),list_max({_Q})) ELSE 0 END",
}


def scored_sql(method: str) -> str:
    return PAIRS + f""",
scored AS (SELECT *, CASE WHEN {_P} IS NULL OR {_Q} IS NULL THEN 0.0::DOUBLE ELSE {SCORE_SQL[method]} END AS s FROM pairs)"""


def _scored(spark, sf, method="confidence_weighted_dot_product"):
    return scoring.score_pairs(pairs_with_probs(spark, sf), method)


@query("g1_softmax", with_(PROBS, f"SELECT comment_id, post_id, generate_subscripts(probs,1)-1 AS class, {r('unnest(probs)','prob')} FROM probs WHERE probs IS NOT NULL"))
def _(spark, sf):
    return tidy(probabilities(spark, sf).select("comment_id", "post_id", F.posexplode("probs").alias("class", "prob")))


for _id, _m in [("g2_confidence_weighted_dot", "confidence_weighted_dot_product"), ("g3_symmetric_kl", "kl_divergence"),
                ("g4_shifted_cosine", "cosine_similarity"), ("g5_simple_dot", "simple_dot_product"),
                ("g6_prediction_agreement", "prediction_agreement")]:
    query(_id, with_(scored_sql(_m), f"SELECT sample_index, {r('s','consistency_score')} FROM scored"))(
        lambda spark, sf, m=_m: tidy(_scored(spark, sf, m).select("sample_index", "consistency_score")))

_STATS = f"""count(*) AS count, {r('avg(s)','mean')}, {r('stddev_pop(s)','std')}, {r('min(s)','min')}, {r('max(s)','max')}, {r('median(s)','median')},
  {r('quantile_cont(s,0.25)','p25')}, {r('quantile_cont(s,0.75)','p75')}, {r('quantile_cont(s,0.9)','p90')}, {r('quantile_cont(s,0.95)','p95')}"""


@query("g7_score_statistics", with_(scored_sql("confidence_weighted_dot_product"), f"SELECT {_STATS} FROM scored"))
def _(spark, sf):
    return tidy(scoring.score_statistics(stored(_scored(spark, sf).select("consistency_score"))))


def noise_ctes(fraction: float, seed: int = 42, sfx: str = "") -> str:
    return f""",
g{sfx} AS (SELECT sample_index, s, CASE WHEN s>=0.4 AND s<0.6 THEN '0.40-0.60' WHEN s>=0.6 AND s<0.8 THEN '0.60-0.80' WHEN s>=0.8 AND s<1.0+1e-8 THEN '0.80-1.00' END AS grp FROM scored),
k{sfx} AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {hash_sql(seed,'sample_index')}, sample_index) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM g{sfx} WHERE grp IS NOT NULL),
t{sfx} AS (SELECT sample_index, grp, s AS original, row_number() OVER (ORDER BY {hash_sql(f'{seed}:target','sample_index')}, sample_index) - 1 AS tn FROM k{sfx} WHERE rk <= ceil(n*{fraction}::DOUBLE)),
pool{sfx} AS (SELECT sample_index AS src, s AS new_s, anchor_content AS new_a, positive_content AS new_p, row_number() OVER (ORDER BY {hash_sql(f'{seed}:pool','sample_index')}, sample_index) - 1 AS pn FROM scored WHERE s BETWEEN 0 AND 0.01+1e-8),
f{sfx} AS (SELECT t.sample_index, grp, original, src, new_s, new_a, new_p FROM t{sfx} t JOIN pool{sfx} ON pn = tn % (SELECT count(*) FROM pool{sfx})),
noisy{sfx} AS (SELECT x.sample_index, x.dataset_type, coalesce(new_a, anchor_content) AS anchor_content, coalesce(new_p, positive_content) AS positive_content, coalesce(new_s, s) AS s, original, new_s, src, grp
  FROM scored x LEFT JOIN f{sfx} USING (sample_index))"""


def noisy_sql(fraction: float, seed: int = 42) -> str:
    return scored_sql("cosine_similarity") + noise_ctes(fraction, seed)


def _noisy(spark, sf, fraction=0.3):
    scored = stored(_scored(spark, sf, "cosine_similarity"))
    return scored, scoring.inject_noise(scored, fraction)


@query("g8_noise_injection", with_(noisy_sql(0.3), f"""SELECT sample_index, md5(anchor_content) AS anchor, md5(positive_content) AS positive, {r('s','consistency_score')},
  {r('original','noise_original_score')}, {r('new_s','noise_replacement_score')}, src AS noise_source_index, grp AS noise_group FROM noisy"""))
def _(spark, sf):
    _s, noisy = _noisy(spark, sf)
    return tidy(noisy.select(
        "sample_index", F.md5("anchor_content").alias("anchor"), F.md5("positive_content").alias("positive"), "consistency_score",
        F.col("noise.original_score").alias("noise_original_score"), F.col("noise.replacement_score").alias("noise_replacement_score"),
        F.col("noise.source_index").alias("noise_source_index"), F.col("noise.group").alias("noise_group")))


@query("g8_noise_breakdown", with_(noisy_sql(0.3), 'SELECT grp AS "group", count(*) AS count FROM noisy WHERE grp IS NOT NULL GROUP BY 1'))
def _(spark, sf):
    return scoring.noise_breakdown(_noisy(spark, sf)[1])


@query("g8_noise_status", with_(noisy_sql(0.3), "SELECT 'applied' AS status, count(grp) AS total_replaced, (SELECT count(*) FROM pool) AS pool_size FROM noisy"))
def _(spark, sf):
    scored, noisy = _noisy(spark, sf)
    return scoring.noise_status(scored, noisy, 0.3)


_INTERVAL = "CASE WHEN s>=0 AND s<0.2 THEN 'very_low' WHEN s>=0.2 AND s<0.4 THEN 'low' WHEN s>=0.4 AND s<0.6 THEN 'medium' WHEN s>=0.6 AND s<0.8 THEN 'high' WHEN s>=0.8 AND s<=1.0 THEN 'very_high' END"


@query("g9_review_sample", with_(scored_sql("cosine_similarity") + f""",
k AS (SELECT *, {_INTERVAL} AS category, row_number() OVER (PARTITION BY {_INTERVAL} ORDER BY {hash_sql(42,'sample_index')}, sample_index) AS rk FROM scored WHERE s BETWEEN 0 AND 1)""",
    f"""SELECT sample_index, {r('s','consistency_score',4)}, category, dataset_type, CASE WHEN length(anchor_content)>100 THEN substr(anchor_content,1,100)||'...' ELSE anchor_content END AS anchor_text,
  CASE WHEN length(positive_content)>100 THEN substr(positive_content,1,100)||'...' ELSE positive_content END AS positive_text, '' AS human_score, '' AS remark FROM k WHERE rk<=50"""))
def _(spark, sf):
    return scoring.review_sample(_scored(spark, sf, "cosine_similarity"))


@query("g9_review_counts", with_(scored_sql("cosine_similarity"), f"SELECT {_INTERVAL} AS category, count(*) AS count FROM scored WHERE s BETWEEN 0 AND 1 GROUP BY 1"))
def _(spark, sf):
    return scoring.review_counts(_scored(spark, sf, "cosine_similarity"))


# ---- weights --------------------------------------------------------------------------------------

def _slim(spark, sf, method):
    return stored(_scored(spark, sf, method).drop("anchor_probs", "positive_probs"))


def _weight_sql(method, expr):
    return with_(scored_sql(method), f"SELECT sample_index, {r('s','consistency_score')}, {r(expr,'sample_weight')} FROM scored")


def _weighted(spark, sf, method, strategy, threshold):
    return weights.weights(_slim(spark, sf, method), strategy, threshold)


_COLS = ["sample_index", "consistency_score", "sample_weight"]
_TIER_W = "CASE WHEN s>=0.4 AND s<0.6 THEN 0.5 WHEN s>=0.6 AND s<0.8 THEN 0.7 WHEN s>=0.8 AND s<=1.0 THEN 0.9 ELSE 0.0 END"


@query("h1_linear_weights", _weight_sql("simple_dot_product", "CASE WHEN s>=0.1 THEN s ELSE 0 END"))
def _(spark, sf):
    return tidy(_weighted(spark, sf, "simple_dot_product", "linear", 0.1).select(*_COLS))


@query("h1_linear_fallback", _weight_sql("confidence_weighted_dot_product", "CASE WHEN (SELECT max(s) FROM scored) >= 0.99 THEN CASE WHEN s>=0.99 THEN s ELSE 0 END ELSE s END"))
def _(spark, sf):
    return tidy(_weighted(spark, sf, "confidence_weighted_dot_product", "linear", 0.99).select(*_COLS))


@query("h2_threshold_weights", _weight_sql("cosine_similarity", "CASE WHEN s>=0.7 THEN 1 ELSE 0 END"))
def _(spark, sf):
    return tidy(_weighted(spark, sf, "cosine_similarity", "threshold", 0.7).select(*_COLS))


@query("h2_threshold_out_of_range", _weight_sql("cosine_similarity", "CASE WHEN s>=0.4 THEN 1 ELSE 0 END"))
def _(spark, sf):
    return tidy(_weighted(spark, sf, "cosine_similarity", "threshold", 1.5).select(*_COLS))


@query("h3_tiered_weights", _weight_sql("cosine_similarity", _TIER_W))
def _(spark, sf):
    return tidy(_weighted(spark, sf, "cosine_similarity", "tiered", 0.0).select(*_COLS))


@query("h3_tier_counts", with_(scored_sql("cosine_similarity"), f"SELECT (CASE WHEN s<0 THEN 0 WHEN s<0.4 THEN 1 WHEN s<0.6 THEN 2 WHEN s<0.8 THEN 3 WHEN s<=1 THEN 4 ELSE 0 END)::BIGINT AS tier, count(*) AS count, {r('count(*)*100.0/sum(count(*)) OVER ()','percentage')} FROM scored GROUP BY 1"))
def _(spark, sf):
    return tidy(weights.tier_counts(_slim(spark, sf, "cosine_similarity")))


@query("h4_filtered_pool", with_(scored_sql("simple_dot_product"), f"SELECT sample_index, md5(anchor_content) AS anchor, md5(positive_content) AS positive, {r('s','consistency_score')} FROM scored WHERE s < 0.1"))
def _(spark, sf):
    pool = weights.filtered_pool(_weighted(spark, sf, "simple_dot_product", "linear", 0.1))
    return tidy(pool.select("sample_index", F.md5("anchor_content").alias("anchor"), F.md5("positive_content").alias("positive"), "consistency_score"))


@query("h5_weight_summary", with_(scored_sql("simple_dot_product") + ", w AS (SELECT s, CASE WHEN s>=0.1 THEN s ELSE 0 END AS w FROM scored)", f"""SELECT count(*) AS total, count(*) FILTER (w>0) AS effective, {r('min(w)','min_weight')}, {r('max(w)','max_weight')}, {r('avg(w)','mean_weight')},
  {r('min(s) FILTER (w>0)','min_kept')}, {r('max(s) FILTER (w>0)','max_kept')}, {r('min(s) FILTER (w=0)','min_filtered')}, {r('max(s) FILTER (w=0)','max_filtered')} FROM w"""))
def _(spark, sf):
    return tidy(weights.weight_summary(_weighted(spark, sf, "simple_dot_product", "linear", 0.1)))


def _two_rounds(spark, sf):
    """Round 1 linear at 0.1, round 2 threshold at 0.12, round 2 recorded again at 0.15."""
    first = weights.append_history(_weighted(spark, sf, "simple_dot_product", "linear", 0.1), 1, "linear", 0.1)
    for t in (0.12, 0.15):
        first = weights.append_history(weights.weights(stored(first.drop("sample_weight")), "threshold", t), 2, "threshold", t)
    return first


@query("h6_append_history", with_(scored_sql("simple_dot_product"), f"""SELECT sample_index, 2::BIGINT AS rounds, s>=0.1 AS trained_1, s>=0.15 AS trained_2, 'threshold' AS strategy_2, 0.15::DOUBLE AS threshold_2,
  {r('CASE WHEN s>=0.1 THEN s ELSE 0 END','weight_1')}, {r('CASE WHEN s>=0.15 THEN 1 ELSE 0 END','weight_2')}, (CASE WHEN s>=0.12 THEN 2 WHEN s>=0.1 THEN 1 END)::BIGINT AS last_trained_round FROM scored"""))
def _(spark, sf):
    h = _two_rounds(spark, sf)
    one, two = F.col("filter_history")["round_1"], F.col("filter_history")["round_2"]
    return tidy(h.select("sample_index", F.size("training_rounds").alias("rounds"), F.col("training_rounds")["round_1"].alias("trained_1"),
                         F.col("training_rounds")["round_2"].alias("trained_2"), two["strategy"].alias("strategy_2"), two["threshold"].alias("threshold_2"),
                         one["weight"].alias("weight_1"), two["weight"].alias("weight_2"), "last_trained_round"))


@query("h7_round_info", with_(scored_sql("simple_dot_product"), f"""SELECT 1::BIGINT AS round, 'linear' AS strategy, 0.1::DOUBLE AS threshold, count(*) AS total_samples, count(*) FILTER (s>=0.1) AS trained_samples, {r('count(*) FILTER (s>=0.1)/count(*)','filter_ratio')} FROM scored
  UNION ALL SELECT 2, 'threshold', 0.12, count(*), count(*) FILTER (s>=0.12), {r('count(*) FILTER (s>=0.12)/count(*)')} FROM scored"""))
def _(spark, sf):
    scored = _slim(spark, sf, "simple_dot_product")
    infos = [weights.round_info(weights.weights(scored, s, t), n, s, t) for n, s, t in ((1, "linear", 0.1), (2, "threshold", 0.12))]
    return tidy(infos[0].unionByName(infos[1]))


_BATCHES = """,
b AS (SELECT *, row_number() OVER (ORDER BY """ + hash_sql(42, "sample_index") + """, sample_index) - 1 AS rn, count(*) OVER () AS total FROM {src}),
batched AS (SELECT *, rn//8 AS batch_id, rn%8 AS position, least(8, total-(rn//8)*8) AS batch_size FROM b)"""


@query("h8_filtered_negatives", with_(scored_sql("simple_dot_product") + _BATCHES.format(src="(SELECT * FROM scored WHERE s>=0.1)") + f""",
pool AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42,'sample_index')}, sample_index) - 1 AS pn, count(*) OVER () AS size FROM scored WHERE s<0.1),
bs AS (SELECT DISTINCT batch_id, batch_size FROM batched),
slots AS (SELECT batch_id, unnest(range(least(batch_size//2, (SELECT count(*) FROM pool)))) AS slot FROM bs)""",
    f"""SELECT batch_id, slot, p.sample_index, md5(CASE WHEN {hash_sql('42:side','batch_id','slot')}%2=0 THEN p.anchor_content ELSE p.positive_content END) AS negative
  FROM slots JOIN pool p ON p.pn = ({hash_sql('42:start','batch_id')} + slot) % p.size"""))
def _(spark, sf):
    w = _weighted(spark, sf, "simple_dot_product", "linear", 0.1)
    b = pair_ops.batch_rows(w.filter("sample_weight > 0").select("sample_index"), 8, ["sample_index"])
    per = b.filter("position = 0").select("batch_id", "batch_size")
    n = weights.filtered_negatives(per, weights.filtered_pool(w), 0.5)
    return n.select("batch_id", "slot", "sample_index", F.md5("negative_content").alias("negative"))


@query("h9_weighted_loss_mean", with_(scored_sql("simple_dot_product") + _BATCHES.format(src="scored"), f"SELECT batch_id, {r('sum(s*(1-s))/sum(s)','weighted_loss')} FROM batched WHERE s>=0.1 GROUP BY 1"))
def _(spark, sf):
    w = _weighted(spark, sf, "simple_dot_product", "linear", 0.1)
    b = pair_ops.batch_rows(w.select("sample_index", "sample_weight", (1 - F.col("consistency_score")).alias("loss")), 8, ["sample_index"])
    return tidy(weights.weighted_mean(b))


# ---- losses ---------------------------------------------------------------------------------------

def _vector_pairs(spark, sf):
    """Reply and parent vectors, where both exist."""
    n = thread_nodes(spark, sf).filter(F.col("embedding").isNotNull())
    child = n.filter(F.col("parent_id") != F.col("post_id")).select("post_id", "parent_id", F.col("seq").alias("sample_index"), F.col("embedding").alias("positive"))
    return child.join(n.select("post_id", F.col("comment_id").alias("parent_id"), F.col("embedding").alias("anchor")), ["post_id", "parent_id"])


def _neg_vectors(spark, sf):
    """Two negatives per pair: the vectors 1 and 7 places further, round the table."""
    vecs = table(spark, sf, "embeddings")
    n = vecs.select(F.count(F.lit(1)).alias("n")).scalar()
    slots = _vector_pairs(spark, sf).select("sample_index", F.explode(F.array(F.lit(1), F.lit(7))).alias("d"))
    return slots.withColumn("vec_id", F.pmod(F.col("sample_index") + F.col("d"), n)).join(vecs, "vec_id").select("sample_index", F.col("embedding").alias("negative"))


_VP = EDGES + """,
vp AS (SELECT c.seq AS sample_index, c.post_id, p.embedding AS a, c.embedding AS p FROM nodes c JOIN nodes p ON p.post_id=c.post_id AND p.comment_id=c.parent_id
  WHERE c.parent_id<>c.post_id AND p.embedding IS NOT NULL AND c.embedding IS NOT NULL),
ng AS (SELECT sample_index, e.embedding::DOUBLE[] AS n FROM (SELECT sample_index, unnest([1,7]) AS d FROM vp) JOIN embeddings e ON e.vec_id = (sample_index+d) % (SELECT count(*) FROM embeddings))"""


def _explicit_sql(bidirectional):
    one = "SELECT sample_index, ln(exp(any_value(list_cosine_similarity(a,p))/0.1)+sum(exp(list_cosine_similarity({q},n)/0.1))) - any_value(list_cosine_similarity(a,p))/0.1 AS l FROM vp JOIN ng USING (sample_index) GROUP BY 1"
    if not bidirectional:
        return with_(_VP, f"SELECT sample_index, {r('l','loss')} FROM ({one.format(q='a')})")
    return with_(_VP, f"SELECT sample_index, {r('(x.l+y.l)/2','loss')} FROM ({one.format(q='a')}) x JOIN ({one.format(q='p')}) y USING (sample_index)")


@query("i1_infonce_explicit", _explicit_sql(False))
def _(spark, sf):
    return tidy(infonce.explicit(_vector_pairs(spark, sf), _neg_vectors(spark, sf), temperature=0.1))


@query("i2_infonce_bidirectional", _explicit_sql(True))
def _(spark, sf):
    return tidy(infonce.explicit(_vector_pairs(spark, sf), _neg_vectors(spark, sf), temperature=0.1, bidirectional=True))


def _batched_vectors(spark, sf):
    return pair_ops.batch_rows(_vector_pairs(spark, sf).select("sample_index", "anchor", "positive"), 8, ["sample_index"])


_IB = _VP + _BATCHES.format(src="vp") + """,
m AS (SELECT x.batch_id, x.position, x.sample_index, y.position AS other, list_cosine_similarity(x.a,y.p)/0.1 AS ap, list_cosine_similarity(x.p,y.a)/0.1 AS pa, list_dot_product(x.a,y.p)/0.1 AS raw
  FROM batched x JOIN batched y USING (batch_id)),
l AS (SELECT batch_id, position, ln(sum(exp(ap)))-max(ap) FILTER (other=position) AS ap, ln(sum(exp(pa)))-max(pa) FILTER (other=position) AS pa, sum(exp(raw)) AS raw_sum, max(raw) FILTER (other=position) AS raw_own FROM m GROUP BY 1,2)"""


@query("i3_infonce_in_batch", with_(_IB, f"SELECT batch_id, position, {r('(ap+pa)/2','loss')} FROM l"))
def _(spark, sf):
    return tidy(infonce.in_batch(_batched_vectors(spark, sf), 0.1, bidirectional=True))


@query("i3_infonce_in_batch_one_way", with_(_IB, f"SELECT batch_id, position, {r('ap','loss')} FROM l"))
def _(spark, sf):
    return tidy(infonce.in_batch(_batched_vectors(spark, sf), 0.1))


@query("i4_infonce_extra_negatives", with_(_IB + """,
ex AS (SELECT batch_id, e.embedding::DOUBLE[] AS n FROM (SELECT DISTINCT batch_id FROM batched) JOIN embeddings e ON e.vec_id = batch_id % (SELECT count(*) FROM embeddings)),
es AS (SELECT b.batch_id, b.position, sum(exp(list_dot_product(b.a, ex.n)/0.1)) AS s FROM batched b JOIN ex USING (batch_id) GROUP BY 1,2)""", f"SELECT batch_id, position, {r('ln(raw_sum+s)-raw_own','loss')} FROM l JOIN es USING (batch_id, position)"))
def _(spark, sf):
    rows = stored(_batched_vectors(spark, sf))
    vecs = table(spark, sf, "embeddings")
    n = vecs.select(F.count(F.lit(1)).alias("n")).scalar()
    extra = rows.filter("position = 0").select("batch_id", F.pmod("batch_id", n).alias("vec_id")).join(vecs, "vec_id").select("batch_id", F.col("embedding").alias("negative"))
    return tidy(infonce.in_batch(rows, 0.1, normalize=False, extra=extra))


# ---- rounds ---------------------------------------------------------------------------------------

@query("m1_curation_round", with_(noisy_sql(0.2, seed=7), f"""SELECT sample_index, {r('s','consistency_score')}, {r('CASE WHEN s>=0.7 THEN 1 ELSE 0 END','sample_weight')}, true AS trained_1, s>=0.7 AS trained_2,
  src AS noise_source_index, (CASE WHEN s>=0.7 THEN 2 ELSE 1 END)::BIGINT AS last_trained_round FROM noisy"""))
def _(spark, sf):
    """Two rounds through the partitioned table: all pairs at 0.0, then noise and a threshold of 0.7."""
    path = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    pairs = pairs_with_probs(spark, sf)
    common = {"strategy": "threshold", "method": "cosine_similarity"}
    out = rounds.run_rounds(pairs, path, [{**common, "threshold": 0.0}, {**common, "threshold": 0.7, "noise": {"fraction": 0.2, "seed": 7}}])
    return tidy(out.select("sample_index", "consistency_score", "sample_weight", F.col("training_rounds")["round_1"].alias("trained_1"),
                           F.col("training_rounds")["round_2"].alias("trained_2"), F.col("noise.source_index").alias("noise_source_index"), "last_trained_round"))


_TEXT_SCORED = PAIRS + f""",
tex AS (SELECT *, {text_exp_sql('anchor_content')} AS ea, {text_exp_sql('positive_content')} AS eb FROM pairs),
tsc AS (SELECT *, list_sum(list_transform(range(1, 6), lambda i: ea[i]/list_sum(ea)*eb[i]/list_sum(eb))) AS ts FROM tex)"""


@query("g7_scores_from_texts", with_(_TEXT_SCORED, f"SELECT sample_index, {r('ts','consistency_score')} FROM tsc"))
def _(spark, sf):
    """Both texts of every pair are classified, each distinct text once."""
    given = pairs_with_probs(spark, sf).drop("anchor_probs", "positive_probs")
    return tidy(scoring.score_pairs(scoring.attach_probabilities(given, text_classes), "simple_dot_product").select("sample_index", "consistency_score"))


@query("m1_resumed_rounds", with_(_TEXT_SCORED.replace("AS ts FROM tex)", "AS ts FROM tex), cut AS (SELECT 0.2005::DOUBLE AS c)"), f"""SELECT variant, sample_index, {r('ts','consistency_score')}, true AS trained_1, ts >= c AS trained_2, 2::BIGINT AS rounds
  FROM tsc, cut, (VALUES ('main'), ('noise_eval')) AS v(variant)"""))
def _(spark, sf):
    """Round 1 on vectors; the run is resumed at round 2 with a classifier of texts and a noise copy from an empty pool."""
    path = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    rounds.run_rounds(pairs_with_probs(spark, sf), path, [{"strategy": "threshold", "threshold": 0.0, "method": "cosine_similarity"}])
    rounds.run_rounds(None, path, [{"strategy": "threshold", "threshold": 0.2005, "method": "simple_dot_product", "classify": text_classes,
                                    "noise_copy": {"fraction": 0.2, "pool": (2.0, 3.0)}}], start=2, spark=spark)
    out = spark.read.parquet(path).filter("round = 2")
    return tidy(out.select("variant", "sample_index", "consistency_score", F.col("training_rounds")["round_1"].alias("trained_1"),
                           F.col("training_rounds")["round_2"].alias("trained_2"), F.size("training_rounds").alias("rounds")))


@query("m2_variant_sweep", with_(scored_sql("simple_dot_product") + """,
v AS (SELECT * FROM (VALUES ('linear',0.0::DOUBLE),('linear',0.1::DOUBLE),('threshold',0.1::DOUBLE),('threshold',0.3::DOUBLE),('threshold',1.0::DOUBLE),('tiered',0.0::DOUBLE)) t(strategy, threshold)),
x AS (SELECT strategy, threshold, s, max(s) OVER (PARTITION BY strategy, threshold) AS top FROM scored, v),
w AS (SELECT strategy, threshold, CASE WHEN strategy='tiered' THEN """ + _TIER_W + """ WHEN top>=threshold AND s<threshold THEN 0 WHEN strategy='linear' THEN s ELSE 1 END AS w FROM x)""",
    f"SELECT strategy, threshold, count(*) AS total, count(*) FILTER (w>0) AS kept, {r('count(*) FILTER (w>0)/count(*)','keep_ratio')}, {r('sum(w)/count(*)','mean_weight')}, {r('sum(w)/nullif(count(*) FILTER (w>0),0)','mean_kept_weight')} FROM w GROUP BY 1,2"))
def _(spark, sf):
    return tidy(rounds.variant_sweep(_scored(spark, sf, "simple_dot_product"),
                                     [("linear", 0.0), ("linear", 0.1), ("threshold", 0.1), ("threshold", 0.3), ("threshold", 1.0), ("tiered", 0.0)]).drop("variant"))


@query("m2_noise_sweep", with_(scored_sql("cosine_similarity") + noise_ctes(0.1, sfx="_a") + noise_ctes(0.3, sfx="_b"),
    f"SELECT 0.1::DOUBLE AS fraction, count(*) AS total, count(grp) AS replaced, {r('avg(s)','mean_score')} FROM noisy_a UNION ALL SELECT 0.3, count(*), count(grp), {r('avg(s)')} FROM noisy_b"))
def _(spark, sf):
    scored = stored(_scored(spark, sf, "cosine_similarity"))
    return tidy(rounds.noise_sweep(scored, (0.1, 0.3)))
