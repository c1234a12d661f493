"""Checked queries: splits, metrics, run tables, retrieval, clustering, encoder reports, topic pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadgrove.functions.vectors import mean_vector, unit
from threadgrove.operators import clustering, encoders, probe, retrieval, runs, splits, topic_pairs
from threadgrove.queries.base import hash_sql, query, r, table, tidy, with_
from threadgrove.plans.evaluation import evaluate_encoder
from threadgrove.session import shared_dir, stored
from threadgrove.sources import tables

# ---- splits ---------------------------------------------------------------------------------------


def _labelled(spark, sf, label="quality"):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def _lab(label="quality", name="lab"):
    return f"""{name} AS (SELECT doc_id AS id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(42,'doc_id')}, doc_id) AS r,
  count(*) OVER (PARTITION BY {label}) AS n FROM labels)"""


@query("j1_exclude_labels", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error','view')")
def _(spark, sf):
    return splits.exclude_labels(table(spark, sf, "events").select("event_id", "event_type"), ["error", "view"], "event_type")


@query("j2_fixed_split", with_(_lab(), """SELECT id, label::BIGINT AS label, part FROM (SELECT *, CASE WHEN n>=100 AND r<=60 THEN 'train' WHEN n>=100 AND r>n-40 THEN 'val'
  WHEN n<100 AND r<=n-ceil(n*0.2::DOUBLE) THEN 'train' WHEN n<100 THEN 'val' END AS part FROM lab) WHERE part IS NOT NULL"""))
def _(spark, sf):
    return tidy(splits.split_fixed(_labelled(spark, sf), 60, 40))


@query("j3_two_file_split", with_(_lab() + ", " + _lab("toxic", "tst"), """SELECT id, label::BIGINT AS label, 'train' AS part FROM lab WHERE r<=50
  UNION ALL SELECT id, label, part FROM (SELECT *, CASE WHEN n>=120 AND r<=30 THEN 'val' WHEN n>=120 AND r<=120 THEN 'test' WHEN n<120 AND r<=n-ceil(n*(1-30.0::DOUBLE/120)) THEN 'val' WHEN n<120 THEN 'test' END AS part FROM tst) WHERE part IS NOT NULL"""))
def _(spark, sf):
    return tidy(splits.split_two_files(_labelled(spark, sf), _labelled(spark, sf, "toxic"), 50, 30, 90))


@query("j4_ratio_split", with_(_lab(), "SELECT id, label::BIGINT AS label, CASE WHEN r/n <= 0.8::DOUBLE THEN 'train' ELSE 'val' END AS part FROM lab"))
def _(spark, sf):
    return tidy(splits.split_ratio(_labelled(spark, sf)))


@query("j5_take_fraction", with_(_lab(), "SELECT id, label::BIGINT AS label FROM lab WHERE r <= round_even(n*0.3::DOUBLE, 0)"))
def _(spark, sf):
    return tidy(splits.take_fraction(_labelled(spark, sf), 0.3))


@query("j6_label_index", "SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS label_id FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, sf):
    return splits.label_index(table(spark, sf, "events").withColumnRenamed("event_type", "label"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def _parts(spark, sf):
    both = splits.split_ratio(_vectors(spark, sf))
    return both.filter("part = 'train'"), both.filter("part = 'val'")


@query("j7_frozen_probe")
def _(spark, sf):
    ids = splits.label_index(_vectors(spark, sf))
    train, val = [stored(d.join(ids, "label")) for d in _parts(spark, sf)]
    model, _f1 = probe.fit_probe(train, val)
    return tidy(probe.classification_metrics(probe.predict(model, val), "label_id"))


@query("j7_probe_invariants", with_("lab AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY " + hash_sql(42, "vec_id") + ", vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)",
    "SELECT count(*) AS rows, true AS sums_to_one, true AS most_likely, true AS best_of_grid FROM lab WHERE r/n > 0.8::DOUBLE"))
def _(spark, sf):
    """What holds for every search: probabilities add up, the likeliest class is predicted, no setting alone does better."""
    ids = splits.label_index(_vectors(spark, sf))
    train, val = [stored(d.join(ids, "label")) for d in _parts(spark, sf)]
    model, f1 = probe.fit_probe(train, val)
    single = [probe.fit_probe(train, val, epochs=(n,), regularisation=(reg,))[1] for n in (20, 100) for reg in (0.0, 0.01)]
    p = probe.predict(model, val)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return p.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
                 F.bool_and(F.element_at("probs", (F.col("prediction") + 1).cast("int")) == F.array_max("probs")).alias("most_likely"),
                 F.lit(f1 == max(single)).alias("best_of_grid"))


_PRED = """pred AS (SELECT quality AS label, 1-toxic AS prediction FROM labels),
c AS (SELECT k AS class, count(*) FILTER (label=k) AS support, count(*) FILTER (prediction=k) AS predicted, count(*) FILTER (label=k AND prediction=k) AS hits
  FROM pred, (SELECT DISTINCT label AS k FROM pred UNION SELECT prediction FROM pred) GROUP BY 1),
m AS (SELECT *, coalesce(hits/nullif(predicted,0),0) AS p, coalesce(hits/nullif(support,0),0) AS r FROM c),
f AS (SELECT *, coalesce(2*p*r/nullif(p+r,0),0) AS f FROM m)"""


def _predictions(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


@query("j8_per_class_metrics", with_(_PRED, f"SELECT class::BIGINT AS class, {r('p','precision')}, {r('r','recall')}, {r('f','f1')}, support, hits FROM f"))
def _(spark, sf):
    return tidy(probe.per_class_metrics(_predictions(spark, sf)))


@query("j8_classification_metrics", with_(_PRED, f"SELECT {r('sum(hits)/sum(support)','accuracy')}, {r('avg(p)','precision')}, {r('avg(r)','recall')}, {r('avg(f)','f1_score')}, {r('sum(hits)/sum(support)','f1_micro')} FROM f"))
def _(spark, sf):
    return tidy(probe.classification_metrics(_predictions(spark, sf)))


# ---- run tables -----------------------------------------------------------------------------------

def _runs(spark, sf):
    """Every order is a training run; every seventh lacks test metrics."""
    o = table(spark, sf, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    tested = F.pmod(k, F.lit(7)) != 0

    def part(scale):
        return F.pmod(F.floor(price * scale), F.lit(1000)) / 1000.0

    s = F.col("o_orderstatus")
    df = o.select(
        k.alias("run_idx"), F.col("o_orderpriority").alias("model_name"), F.when(s == "F", 1.0).when(s == "O", 0.5).otherwise(0.1).alias("data_fraction"),
        F.pmod(k, F.lit(5)).cast("int").alias("seed"), F.when(F.pmod(k, F.lit(2)) == 0, "mlp").otherwise("linear").alias("classifier_type"), F.lit(64).alias("mlp_hidden_neurons"),
        F.lit(True).alias("freeze_encoder"), (F.pmod(k, F.lit(3)) * 10 + 10).cast("int").alias("epochs"), F.lit(16).alias("batch_size"), F.lit(0.001).alias("learning_rate"),
        part(1).alias("val_f1"), F.when(tested, part(10)).alias("test_f1"), F.when(tested, part(100)).alias("test_accuracy"),
        F.when(tested, F.pmod("o_custkey", F.lit(997)) / 997).alias("test_precision"), F.when(tested, F.pmod("o_custkey", F.lit(991)) / 991).alias("test_recall"),
        F.when(s == "P", "error").otherwise("success").alias("status"))
    return runs.by_model_fraction(df)


_RUNS = """runs AS (SELECT o_orderkey AS run_idx, o_orderpriority AS model_name, (CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.1 END)::DOUBLE AS data_fraction, o_orderkey%5 AS seed,
  CASE WHEN o_orderkey%2=0 THEN 'mlp' ELSE 'linear' END AS classifier_type, CASE WHEN o_orderkey%2=0 THEN 64 ELSE 0 END::BIGINT AS mlp_hidden_neurons, true AS freeze_encoder, (o_orderkey%3*10+10)::BIGINT AS epochs, 16::BIGINT AS batch_size, 0.001::DOUBLE AS learning_rate,
  floor(o_totalprice)%1000/1000 AS val_f1, CASE WHEN o_orderkey%7<>0 THEN floor(o_totalprice*10)%1000/1000 END AS test_f1, CASE WHEN o_orderkey%7<>0 THEN floor(o_totalprice*100)%1000/1000 END AS test_accuracy,
  CASE WHEN o_orderkey%7<>0 THEN (o_custkey%997)/997 END AS test_precision, CASE WHEN o_orderkey%7<>0 THEN (o_custkey%991)/991 END AS test_recall, CASE WHEN o_orderstatus='P' THEN 'error' ELSE 'success' END AS status,
  o_orderpriority||'_frac'||(CASE o_orderstatus WHEN 'F' THEN '1.0' WHEN 'O' THEN '0.5' ELSE '0.1' END) AS model_fraction FROM orders),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model_name, data_fraction ORDER BY val_f1 DESC NULLS LAST, run_idx)=1),
tested AS (SELECT * FROM runs WHERE test_f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_name, data_fraction ORDER BY val_f1 DESC NULLS LAST, run_idx)=1)"""


def _tested_best(spark, sf):
    return runs.best_runs(_runs(spark, sf).filter("test_f1 is not null"))


@query("a5_run_scan", with_(_RUNS, f"SELECT model_fraction, model_name, data_fraction, run_idx, seed, {r('val_f1','val_f1')}, {r('test_f1','test_f1')}, {r('test_recall','test_recall')} FROM runs"))
def _(spark, sf):
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    tables.write_runs(_runs(spark, sf), path)
    return tidy(tables.read_runs(spark, path).select("model_fraction", "model_name", "data_fraction", "run_idx", "seed", "val_f1", "test_f1", "test_recall"))


@query("k1_group_runs", with_(_RUNS, "SELECT model_fraction, count(*) AS runs, count(DISTINCT seed) AS seeds, md5(string_agg(run_idx, ',' ORDER BY run_idx)) AS digest FROM runs GROUP BY 1"))
def _(spark, sf):
    return runs.group_runs(_runs(spark, sf)).select("model_fraction", "runs", "seeds", F.md5(F.array_join("run_indexes", ",")).alias("digest"))


@query("k2_best_runs", with_(_RUNS, f"SELECT model_name, data_fraction, run_idx, {r('val_f1','val_f1')} FROM best"))
def _(spark, sf):
    return tidy(runs.best_runs(_runs(spark, sf)).select("model_name", "data_fraction", "run_idx", "val_f1"))


@query("k2_global_best", with_(_RUNS, f"SELECT model_name, data_fraction, run_idx, {r('val_f1','val_f1')} FROM runs ORDER BY val_f1 DESC NULLS LAST, run_idx LIMIT 1"))
def _(spark, sf):
    return tidy(runs.best_run(_runs(spark, sf)).select("model_name", "data_fraction", "run_idx", "val_f1"))


_MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("k3_comparison", with_(_RUNS, "SELECT data_fraction, " + ", ".join(f"round(max(test_f1) FILTER (model_name='{m}'),4)+0.0 AS \"{m}\"" for m in _MODELS) + " FROM tested GROUP BY 1"))
def _(spark, sf):
    return tidy(runs.comparison(_tested_best(spark, sf), "test_f1", _MODELS))


@query("k4_best_overall", with_(_RUNS + """,
long AS (SELECT run_idx, model_name, data_fraction, unnest(['test_accuracy','test_f1','test_precision','test_recall']) AS metric, unnest([test_accuracy,test_f1,test_precision,test_recall]) AS value FROM tested)""",
    f"SELECT metric, run_idx, model_name, data_fraction, {r('value','value')} FROM long QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, run_idx)=1"))
def _(spark, sf):
    return tidy(runs.best_overall(_tested_best(spark, sf)))


@query("k4_best_overall_by_validation", with_(_RUNS + """,
long AS (SELECT run_idx, model_name, data_fraction, unnest(['test_accuracy','test_f1','test_precision','test_recall','val_f1']) AS metric, unnest([test_accuracy,test_f1,test_precision,test_recall,val_f1]) AS value FROM best)""",
    f"SELECT metric, run_idx, model_name, data_fraction, {r('value','value')} FROM long WHERE (metric='val_f1') = EXISTS (SELECT 1 FROM best WHERE test_f1 IS NULL) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, run_idx)=1"))
def _(spark, sf):
    return tidy(runs.best_overall(runs.best_runs(_runs(spark, sf))))


@query("k5_fraction_trend", with_(_RUNS, f"SELECT model_name, row_number() OVER (PARTITION BY model_name ORDER BY data_fraction DESC) AS step, data_fraction, {r('test_f1','test_f1')}, {r('test_accuracy','test_accuracy')} FROM tested"))
def _(spark, sf):
    return tidy(runs.fraction_trend(_tested_best(spark, sf)))


_TM = runs.TEST_METRICS


@query("k6_config_summary", with_(_RUNS, f"SELECT {','.join(runs.CONFIG)}, {', '.join(r(f'avg({m})', m+'_mean') for m in _TM)}, {', '.join(r(f'stddev_samp({m})', m+'_std') for m in _TM)}, count(*) AS num_runs FROM runs WHERE test_f1 IS NOT NULL GROUP BY ALL"))
def _(spark, sf):
    return tidy(runs.config_summary(_runs(spark, sf)))


_SEED = ", ".join(r(f"{f}({m})", f"{m}_{n}") for m in runs.SEED_METRICS for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("k7_seed_stats", with_(_RUNS, f"SELECT model_fraction, {_SEED}, count(*) AS num_seeds FROM runs GROUP BY 1"))
def _(spark, sf):
    return tidy(runs.seed_stats(_runs(spark, sf)))


_CLOSE = _RUNS + """,
near AS (SELECT *, avg(test_f1) OVER (PARTITION BY model_fraction) AS mean_value FROM runs),
closest AS (SELECT *, abs(test_f1-mean_value) AS d FROM near WHERE test_f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model_fraction ORDER BY abs(test_f1-mean_value), run_idx)=1)"""


@query("k8_closest_to_mean", with_(_CLOSE, f"SELECT model_fraction, run_idx, seed, {r('test_f1','test_f1')}, {r('mean_value','mean_value')}, {r('d','distance_to_mean')} FROM closest"))
def _(spark, sf):
    return tidy(runs.closest_to_mean(_runs(spark, sf)).select("model_fraction", "run_idx", "seed", "test_f1", "mean_value", "distance_to_mean"))


@query("k9_select_for_fractions", with_(_CLOSE, f"""SELECT c.*, s.* EXCLUDE (model_fraction) FROM (SELECT model_fraction, data_fraction AS fraction, seed, run_idx, {r('test_f1','selected_value')}, {r('mean_value','mean_value')}, {r('d','distance_to_mean')} FROM closest WHERE data_fraction IN (1.0,0.5)) c
  JOIN (SELECT model_fraction, {_SEED}, count(*) AS num_seeds FROM runs GROUP BY 1) s USING (model_fraction)"""))
def _(spark, sf):
    return tidy(runs.select_for_fractions(_runs(spark, sf), [1.0, 0.5]))


@query("k10_grid_summary", with_(_RUNS, f"SELECT count(*) AS total_runs, count(*) FILTER (status='success') AS successful_runs, count(*) FILTER (status<>'success') AS failed_runs, (SELECT run_idx FROM runs WHERE status='success' ORDER BY val_f1 DESC, run_idx LIMIT 1) AS best_run_idx, {r('max(val_f1) FILTER (status=$$success$$)','best_val_f1')} FROM runs"))
def _(spark, sf):
    return tidy(runs.grid_summary(_runs(spark, sf)))


@query("k10_grid_rows", with_(_RUNS, "SELECT run_idx, model_name, data_fraction, seed, CASE WHEN status='success' THEN printf('%.4f', val_f1) ELSE 'FAILED' END AS val_f1, status FROM runs"))
def _(spark, sf):
    return tidy(runs.grid_rows(_runs(spark, sf)))


# ---- retrieval ------------------------------------------------------------------------------------

_VECS = "vecs AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"
_RANKED = _VECS + f""",
parts AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42,'id')}, id) / count(*) OVER (PARTITION BY label) <= 0.8::DOUBLE AS train FROM vecs),
sims AS (SELECT q.id AS query_id, c.id AS candidate_id, q.label=c.label AS same, round(list_cosine_similarity(q.embedding,c.embedding),12) AS similarity FROM parts q JOIN parts c ON q.train AND NOT c.train),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM sims)"""


@query("l1_rank_candidates", with_(_RANKED, f"SELECT query_id, candidate_id, {r('similarity','similarity')}, same, rank FROM ranked WHERE rank<=20"))
def _(spark, sf):
    return tidy(retrieval.rank_candidates(*_parts(spark, sf), k=20, block=512))


_PK = "avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) FILTER (rank<={k})"


@query("l2_precision_at_k", with_(_RANKED, " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, {r(_PK.format(k=k),'precision')} FROM ranked" for k in (1, 3, 5, 10, 20))))
def _(spark, sf):
    q, c = _parts(spark, sf)
    n, m = [d.select(F.count(F.lit(1)).alias("n")).scalar() for d in (q, c)]
    return tidy(retrieval.precision_at_k(retrieval.rank_candidates(q, c, 20, block=512), n, (1, 3, 5, 10, 20), m))


_MRR = "rr AS (SELECT query_id, coalesce(1.0/min(rank) FILTER (same),0) AS rr FROM ranked GROUP BY 1)"


@query("l3_mrr", with_(_RANKED + ", " + _MRR, f"SELECT {', '.join(r(f'(SELECT {_PK.format(k=k)} FROM ranked)', f'precision_at_{k}') for k in (1,3))}, {r('avg(rr)','mrr')}, count(*) AS sample_count FROM rr"))
def _(spark, sf):
    return tidy(retrieval.evaluate(*_parts(spark, sf), ks=(1, 3), block=512))


_INTRA = _VECS + """,
p AS (SELECT a.label, list_cosine_similarity(a.embedding,b.embedding) AS s FROM vecs a JOIN vecs b ON a.label=b.label AND a.id<b.id),
intra AS (SELECT label, avg(s) AS m, stddev_pop(s) AS sd, min(s) AS lo, max(s) AS hi FROM p GROUP BY 1)"""


@query("l4_intra_class", with_(_INTRA, f"SELECT label::VARCHAR AS label, (SELECT count(*) FROM vecs v WHERE v.label=intra.label) AS size, {r('m','intra_similarity')}, {r('sd','intra_std')} FROM intra"))
def _(spark, sf):
    return tidy(clustering.intra_class(_vectors(spark, sf)))


@query("l4_intra_class_range", with_(_INTRA, f"SELECT label::BIGINT AS label, {r('lo','intra_min')}, {r('hi','intra_max')} FROM intra"))
def _(spark, sf):
    return tidy(clustering.intra_class_range(_vectors(spark, sf), block=64))


_CENT = """,
u AS (SELECT label, unnest(embedding) AS x, unnest(list_transform(embedding, lambda v: v/sqrt(list_dot_product(embedding,embedding)))) AS y, generate_subscripts(embedding,1) AS i FROM vecs),
c AS (SELECT label, list(x ORDER BY i) AS c, list(y ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x, avg(y) AS y FROM u GROUP BY 1,2) GROUP BY 1),
inter AS (SELECT list_cosine_similarity(a.c,b.c) AS s, list_dot_product(a.m,b.m) AS e FROM c a JOIN c b ON a.label<b.label)"""


@query("l5_inter_class_centroids", with_(_VECS + _CENT, f"SELECT (SELECT count(*) FROM c) AS num_classes, {r('avg(s)','inter_similarity')}, {r('stddev_pop(s)','inter_std')} FROM inter"))
def _(spark, sf):
    return tidy(clustering.inter_class_centroids(_vectors(spark, sf)))


@query("l6_inter_class_exact", with_(_VECS + _CENT, f"SELECT (SELECT count(*) FROM c) AS num_classes, {r('avg(e)','inter_similarity')} FROM inter"))
def _(spark, sf):
    return tidy(clustering.inter_class_exact(_vectors(spark, sf)))


@query("l7_margin", with_(_INTRA + _CENT, f"SELECT {r('(SELECT avg(m) FROM intra)','intra_class_similarity')}, {r('avg(s)','inter_class_similarity')}, {r('(SELECT avg(m) FROM intra)-avg(s)','margin')}, (SELECT count(*) FROM c) AS num_classes FROM inter"))
def _(spark, sf):
    return tidy(clustering.class_separation(_vectors(spark, sf)))


@query("encoder_metrics", with_(_RANKED + ", " + _MRR + """,
p AS (SELECT list_cosine_similarity(a.embedding,b.embedding) AS s, a.label FROM parts a JOIN parts b ON a.label=b.label AND a.id<b.id AND NOT a.train AND NOT b.train),
u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding,1) AS i FROM parts WHERE NOT train),
c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM u GROUP BY 1,2) GROUP BY 1),
intra AS (SELECT avg(m) AS m FROM (SELECT avg(s) AS m FROM p GROUP BY label)), inter AS (SELECT avg(list_cosine_similarity(a.c,b.c)) AS m FROM c a JOIN c b ON a.label<b.label)""",
    f"SELECT 'given' AS encoder, {', '.join(r(f'(SELECT {_PK.format(k=k)} FROM ranked)', f'precision_at_{k}') for k in (1,5))}, {r('avg(rr)','mrr')}, {r('(SELECT m FROM intra)','intra_sim')}, {r('(SELECT m FROM inter)','inter_sim')}, {r('(SELECT m FROM intra)-(SELECT m FROM inter)','margin')} FROM rr"))
def _(spark, sf):
    train, test = _parts(spark, sf)
    return tidy(evaluate_encoder("given", train, test, ks=(1, 5), kmeans=False, block=512))


@query("l8_kmeans")
def _(spark, sf):
    rows, inertia = clustering.kmeans_labels(_vectors(spark, sf))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).withColumn("inertia", F.round(F.lit(inertia), 4))


@query("l8_kmeans_invariants", "SELECT count(*) AS rows, count(DISTINCT label) AS clusters, 0::BIGINT AS off_nearest, true AS inertia_agrees FROM embeddings")
def _(spark, sf):
    """What holds for every k-means result: each row is in the cluster of its nearest centre, and inertia adds up."""
    rows, inertia = clustering.kmeans_labels(_vectors(spark, sf))
    spots = rows.select("id", "cluster", F.posexplode(unit("embedding")).alias("pos", "x"))
    centres = spots.groupBy("cluster", "pos").agg(F.avg("x").alias("c")).withColumnRenamed("cluster", "centre")
    far = (spots.join(centres, "pos").groupBy("id", "cluster", "centre")
           .agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d")))
    own = F.max(F.when(F.col("cluster") == F.col("centre"), F.col("d")))
    each = far.groupBy("id", "cluster").agg(own.alias("own"), F.min("d").alias("least"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").alias("clusters"),
                    F.count_if(F.col("own") > F.col("least") + 1e-2).alias("off_nearest"),
                    (F.abs(F.sum("own") / inertia - 1) < 1e-3).alias("inertia_agrees"))


def _clusters(spark, sf):
    """Cluster = place of the largest component."""
    return _vectors(spark, sf).withColumn("cluster", F.array_position("embedding", F.array_max("embedding")) - 1)


_TABLE = _VECS + """,
t AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS cluster, count(*) AS n FROM vecs GROUP BY 1,2),
a AS (SELECT label, sum(n) AS a FROM t GROUP BY 1), b AS (SELECT cluster, sum(n) AS b FROM t GROUP BY 1), z AS (SELECT sum(n)::DOUBLE AS z FROM t)"""


@query("l9_nmi", with_(_TABLE, f"""SELECT {r('(SELECT sum(n/z*ln(n*z/(a*b))) FROM t JOIN a USING (label) JOIN b USING (cluster), z) / (((SELECT -sum(a/z*ln(a/z)) FROM a, z) + (SELECT -sum(b/z*ln(b/z)) FROM b, z))/2)','nmi')}"""))
def _(spark, sf):
    return tidy(clustering.nmi(clustering.contingency(_clusters(spark, sf))))


# best[mask] after cluster i: the most rows that clusters 1 to i can share with the labels of the mask, one each
@query("l10_cluster_accuracy", with_(_TABLE + """,
ls AS (SELECT label, (1 << (row_number() OVER (ORDER BY label) - 1)::INT)::BIGINT AS bit FROM a),
cs AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS i FROM b),
cell AS (SELECT i, bit, n FROM t JOIN ls USING (label) JOIN cs USING (cluster)),
dp AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS mask, 0::DOUBLE AS best
  UNION ALL
  SELECT i, mask, max(best) FROM (
    SELECT dp.i + 1 AS i, dp.mask AS mask, dp.best AS best FROM dp WHERE dp.i < (SELECT count(*) FROM cs)
    UNION ALL
    SELECT dp.i + 1, dp.mask + cell.bit, dp.best + cell.n FROM dp JOIN cell ON cell.i = dp.i + 1 AND (dp.mask & cell.bit) = 0) GROUP BY i, mask)""",
    f"SELECT {r('max(best)/(SELECT z FROM z)','accuracy')} FROM dp"))
def _(spark, sf):
    return tidy(clustering.cluster_accuracy(clustering.contingency(_clusters(spark, sf))))


@query("l10_purity", with_(_TABLE, f"SELECT {r('sum(m)/(SELECT z FROM z)','purity')} FROM (SELECT max(n) AS m FROM t GROUP BY cluster)"))
def _(spark, sf):
    return tidy(clustering.purity(clustering.contingency(_clusters(spark, sf))))


@query("l11_ari", with_(_TABLE + """,
q AS (SELECT (SELECT sum(n*(n-1)/2) FROM t) AS s, (SELECT sum(a*(a-1)/2) FROM a) AS sa, (SELECT sum(b*(b-1)/2) FROM b) AS sb, z*(z-1)/2 AS tot FROM z)""", f"SELECT {r('(s-sa*sb/tot)/((sa+sb)/2-sa*sb/tot)','ari')} FROM q"))
def _(spark, sf):
    return tidy(clustering.ari(clustering.contingency(_clusters(spark, sf))))


# ---- encoder reports ------------------------------------------------------------------------------

_METRICS = ["mrr", "precision_at_1", "intra_sim", "inter_sim", "margin", "nmi", "acc", "ari"]
_SCALES = [1, 10, 100, 2, 3, 4, 5, 6]


def _encoder_metrics(spark, sf):
    """Metrics of nine made-up encoders, averaged over all orders."""
    g = F.pmod("o_orderkey", F.lit(9))
    o = table(spark, sf, "orders").withColumn("g", g)
    m = [F.round(F.avg(F.pmod(F.floor(F.col("o_totalprice") * s) + F.col("g") * 37, F.lit(1000)) / 1000), 9).alias(n) for n, s in zip(_METRICS, _SCALES)]
    t = o.groupBy("g").agg(*m)
    return t.select(F.when(F.col("g") == 0, "base_a").when(F.col("g") == 1, "base_b").otherwise(F.concat(F.lit("round"), F.col("g") - 1)).alias("encoder"),
                    F.when(F.col("g") > 1, F.col("g") - 1).alias("round"), (F.col("g") <= 1).alias("is_baseline"), *_METRICS)


_ENC = "g AS (SELECT *, o_orderkey%9 AS g FROM orders), m AS (SELECT g, " + ", ".join(
    f"round(avg((floor(o_totalprice*{s}) + g*37)%1000/1000),9) AS {n}" for n, s in zip(_METRICS, _SCALES)) + """ FROM g GROUP BY 1),
enc AS (SELECT CASE g WHEN 0 THEN 'base_a' WHEN 1 THEN 'base_b' ELSE 'round'||(g-1) END AS encoder, CASE WHEN g>1 THEN g-1 END AS round, g<=1 AS is_baseline, * EXCLUDE (g) FROM m),
long AS (SELECT encoder, is_baseline, unnest([""" + ",".join(f"'{m}'" for m in _METRICS) + "]) AS metric, unnest([" + ",".join(_METRICS) + "]) AS value FROM enc)"


@query("l12_encoder_comparison", with_(_ENC, f"SELECT encoder, {', '.join(r(m, m) for m in _METRICS)} FROM enc"))
def _(spark, sf):
    long = _encoder_metrics(spark, sf).unpivot(["encoder"], _METRICS, "metric", "value")
    return tidy(encoders.sorted_by(encoders.encoder_comparison(long, _METRICS), "margin"))


@query("l13_best_encoders", with_(_ENC, f"SELECT metric, encoder, {r('value','value')} FROM long QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric='inter_sim' THEN -value ELSE value END DESC, encoder)=1"))
def _(spark, sf):
    return tidy(encoders.best_encoders(_encoder_metrics(spark, sf), _METRICS))


@query("l14_improvement", with_(_ENC, f"SELECT b.encoder AS baseline, e.encoder, e.metric, {r('(e.value-b.value)/b.value*100','improvement_percentage')} FROM long e JOIN long b ON b.metric=e.metric AND b.is_baseline AND NOT e.is_baseline WHERE e.metric IN ('mrr','precision_at_1')"))
def _(spark, sf):
    return tidy(encoders.improvement(_encoder_metrics(spark, sf), ["mrr", "precision_at_1"]))


def _trend_sql(ms):
    marks = ", ".join(f"CASE WHEN {m} {'<' if m == 'inter_sim' else '>'} lag({m}) OVER (ORDER BY round) THEN '{encoders.TREND_LABELS[m]}' END" for m in ms)
    return with_(_ENC, f"SELECT round, {', '.join(r(m, m) for m in ms)}, coalesce(nullif(concat_ws(', ', {marks}),''),'-') AS trend FROM enc WHERE round IS NOT NULL")


@query("l15_round_trend", _trend_sql(["intra_sim", "inter_sim", "margin"]))
def _(spark, sf):
    return tidy(encoders.round_trend(_encoder_metrics(spark, sf)))


@query("l15_round_trend_kmeans", _trend_sql(["nmi", "acc", "ari"]))
def _(spark, sf):
    return tidy(encoders.round_trend(_encoder_metrics(spark, sf), ("nmi", "acc", "ari")))


@query("l16_round_delta", with_(_ENC + """,
f AS (SELECT * FROM enc WHERE round=1), d AS (SELECT e.round, e.intra_sim-f.intra_sim AS a, e.inter_sim-f.inter_sim AS b, e.margin-f.margin AS c FROM enc e, f WHERE e.round IS NOT NULL)""",
    f"SELECT round, {r('a','intra_sim_delta')}, {r('b','inter_sim_delta')}, {r('c','margin_delta')}, CASE WHEN round=1 THEN 'Baseline' ELSE coalesce(nullif(concat_ws(', ', CASE WHEN a>0.05 THEN 'Intra up' END, CASE WHEN b<-0.05 THEN 'Inter down' END, CASE WHEN c>0.1 THEN 'Strong improvement' END),''),'-') END AS note FROM d"))
def _(spark, sf):
    return tidy(encoders.round_delta(_encoder_metrics(spark, sf)))


# ---- topic pairs ----------------------------------------------------------------------------------

_TOPIC = _VECS + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42,'id')}, id) AS r, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS z FROM vecs),
st AS (SELECT label, coalesce(sum(c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS start FROM (SELECT label, count(*) AS c FROM vecs GROUP BY 1)),
pl AS (SELECT k.*, start, start+r-1 AS place FROM k JOIN st USING (label)),
dr AS (SELECT id, embedding, 1 AS truth, start + (r-1 + {hash_sql('42:positive','id')}%(n-1)+1)%n AS tgt FROM pl
  UNION ALL SELECT id, embedding, 0, {hash_sql('42:negative','id')}%(z-n) + CASE WHEN {hash_sql('42:negative','id')}%(z-n) >= start THEN n ELSE 0 END FROM pl),
tp AS (SELECT d.id||'-'||truth AS pair_id, truth::BIGINT AS truth, d.id, p.id AS partner, round(list_cosine_similarity(d.embedding,p.embedding),9) AS score FROM dr d JOIN pl p ON p.place=d.tgt)"""


@query("l17_topic_pairs", with_(_TOPIC, f"SELECT pair_id, truth, id, partner, {r('score','score')} FROM tp"))
def _(spark, sf):
    return tidy(topic_pairs.topic_pairs(_vectors(spark, sf)))


@query("l17_pair_metrics", with_(_TOPIC + """,
g AS (SELECT score, sum(truth)::BIGINT AS p, sum(1-truth)::BIGINT AS n FROM tp GROUP BY 1),
h AS (SELECT *, sum(n) OVER w - n AS nb, sum(p) OVER w - p AS pb, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
acc AS (SELECT score, (ap-pb+nb)/(ap+an) AS acc FROM h ORDER BY acc DESC, score LIMIT 1),
tr AS (SELECT truth, row_number() OVER (ORDER BY score DESC, pair_id) AS rk FROM tp)""",
    f"SELECT {r('(SELECT sum(p*(nb+n/2))/any_value(ap*an) FROM h)','auc')}, {r('(SELECT acc FROM acc)','accuracy')}, {r('(SELECT score FROM acc)','best_threshold')}, {', '.join(r(f'(SELECT avg(truth) FROM tr WHERE rk<={k})', f'precision_at_{k}') for k in (10, 50, 100, 500))}"))
def _(spark, sf):
    return tidy(topic_pairs.pair_metrics(stored(topic_pairs.topic_pairs(_vectors(spark, sf)))))


# ---- pooling --------------------------------------------------------------------------------------

@query("c2_masked_mean", with_(_VECS + ", v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding,1)-1 AS pos FROM vecs WHERE embedding[1] >= 0)", f"SELECT label::BIGINT AS label, pos, {r('avg(x)','value')} FROM v GROUP BY 1,2"))
def _(spark, sf):
    """Vectors as the tokens of a text per label; the mask leaves out those with a negative first component."""
    masked = _vectors(spark, sf).withColumn("mask", (F.col("embedding")[0] >= 0).cast("int"))
    return tidy(mean_vector(masked, ["label"], mask="mask").select("label", F.posexplode("center").alias("pos", "value")))


@query("c2_first_vector", with_(_VECS + ", f AS (SELECT * FROM vecs QUALIFY row_number() OVER (PARTITION BY label ORDER BY id)=1)", f"SELECT label::BIGINT AS label, generate_subscripts(embedding,1)-1 AS pos, {r('unnest(embedding)','value')} FROM f"))
def _(spark, sf):
    from threadgrove.functions.vectors import first_vector
    return tidy(first_vector(_vectors(spark, sf), ["label"], "id").select("label", F.posexplode("center").alias("pos", "value")))
