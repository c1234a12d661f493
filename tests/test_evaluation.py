"""Retrieval, clustering, probe and run tables against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadgrove.operators import clustering, encoders, probe, retrieval, runs, splits, topic_pairs
from threadgrove.operators.clustering import _best_assignment

VEC = "id long, label int, embedding array<float>"


def cloud(spark, n, seed=0, classes=3, dim=6, start=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("float32")
    y = rng.integers(0, classes, n)
    x[np.arange(n), y] += 1.0
    return spark.createDataFrame([(start + i, int(y[i]), x[i].tolist()) for i in range(n)], VEC), x.astype(float), y


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 1000])
def test_retrieval_equals_full_ranking(spark, block):
    q, qx, qy = cloud(spark, 40, 1)
    c, cx, cy = cloud(spark, 25, 2, start=100)
    order = np.argsort(-(unit(qx) @ unit(cx).T), axis=1, kind="stable")
    same = cy[order] == qy[:, None]
    got = retrieval.evaluate(q, c, ks=(1, 2, 30), block=block).first()
    assert got.mrr == pytest.approx(np.mean([1 / (np.argmax(s) + 1) if s.any() else 0 for s in same]))
    for k in (1, 2, 30):
        assert got[f"precision_at_{k}"] == pytest.approx(same[:, :k].mean(axis=1).mean())
    top = retrieval.rank_candidates(q, c, 3, block=block).orderBy("query_id", "rank").toPandas()
    assert top.candidate_id.to_numpy().reshape(40, 3).tolist() == (order[:, :3] + 100).tolist()


def test_query_without_partner_has_rank_zero(spark):
    q = spark.createDataFrame([(1, 9, [1.0, 0.0])], VEC)
    c = spark.createDataFrame([(2, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0])], VEC)
    assert retrieval.evaluate(q, c, ks=(1, 5)).first().mrr == 0.0


def test_far_match_is_counted_in_the_second_pass(spark):
    q = spark.createDataFrame([(1, 9, [1.0, 0.0])], VEC)
    c = spark.createDataFrame([(10 + i, 1, [1.0, 0.01 * i]) for i in range(30)] + [(99, 9, [0.0, 1.0])], VEC)
    assert retrieval.evaluate(q, c, ks=(1,), block=8).first().mrr == pytest.approx(1 / 31)


@pytest.mark.parametrize("block", [5, 1000])
def test_class_figures_equal_all_pairs(spark, block):
    df, x, y = cloud(spark, 60, 3)
    lone = spark.createDataFrame([(999, 77, [1.0] * 6)], VEC)
    u = unit(x)
    got = {r.label: r for r in clustering.intra_class(df.unionByName(lone)).collect()}
    ends = {r.label: r for r in clustering.intra_class_range(df.unionByName(lone), block=block).collect()}
    assert set(got) == {"0", "1", "2"} and set(ends) == {0, 1, 2}
    for k in range(3):
        s = (u[y == k] @ u[y == k].T)[np.triu_indices((y == k).sum(), 1)]
        assert (got[str(k)].intra_similarity, got[str(k)].intra_std) == pytest.approx((s.mean(), s.std()))
        assert (ends[k].intra_min, ends[k].intra_max) == pytest.approx((s.min(), s.max()))
    cents = unit(np.array([x[y == k].mean(axis=0) for k in range(3)]))
    s = (cents @ cents.T)[np.triu_indices(3, 1)]
    inter = clustering.inter_class_centroids(df).first()
    assert (inter.inter_similarity, inter.inter_std) == pytest.approx((s.mean(), s.std()))
    cross = np.mean([(u[y == a] @ u[y == b].T).mean() for a, b in itertools.combinations(range(3), 2)])
    assert clustering.inter_class_exact(df).first().inter_similarity == pytest.approx(cross)


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (4, 4), (1, 1), (5, 5)])
def test_assignment_equals_all_permutations(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        g = rng.integers(0, 9, shape).astype(float)
        a = g if shape[0] <= shape[1] else g.T
        best = max(sum(a[i, p[i]] for i in range(a.shape[0])) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
        assert _best_assignment(g) == best


def test_cluster_accuracy_per_key(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), ("a", 1, 6), ("a", 1, 5), ("b", 0, 1), ("b", 1, 1)], "enc string, label int, cluster int")
    got = clustering.cluster_accuracy(clustering.contingency(df, by=("enc",)), ("enc",)).collect()
    assert {x.enc: x.accuracy for x in got} == {"a": 0.75, "b": 0.5}


def test_agreement_of_equal_and_single_clusters(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(12)], "label int, cluster int")
    one = spark.createDataFrame([(0, 0), (0, 0)], "label int, cluster int")
    for df in (same, one):
        t = clustering.contingency(df)
        assert clustering.nmi(t).first().nmi == pytest.approx(1.0)
        assert clustering.ari(t).first().ari == pytest.approx(1.0)


def test_kmeans_finds_clear_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 3, (np.eye(4)[i % 3] * 5 + rng.normal(size=4) * 0.1).tolist()) for i in range(60)]
    out, inertia = clustering.kmeans_labels(spark.createDataFrame(rows, VEC), n_init=3)
    assert clustering.cluster_accuracy(clustering.contingency(out)).first().accuracy == 1.0 and inertia < 1


@pytest.mark.parametrize("kind", ["linear", "mlp"])
def test_probe_learns_separable_classes(spark, kind):
    df, _, _ = cloud(spark, 150, 5)
    far = df.withColumn("embedding", F.transform("embedding", lambda x, i: x + F.when(i == F.col("label"), 8.0).otherwise(0.0)).cast("array<float>"))
    rows = far.withColumn("label_id", F.col("label"))
    model, f1 = probe.fit_probe(rows, rows, kind, epochs=(60,), regularisation=(0.001,), hidden=8)
    assert f1 > 0.95
    out = probe.predict(model, rows).first()
    assert len(out.probs) == 3 and sum(out.probs) == pytest.approx(1.0)


def test_metrics_with_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    m = probe.classification_metrics(df).first()
    assert (m.accuracy, m.precision, m.recall) == pytest.approx((0.75, (2 / 3 + 0 + 1) / 3, 2 / 3))


def test_split_parts_are_disjoint(spark):
    df = spark.createDataFrame([(i, "big" if i < 50 else "small") for i in range(57)], "id long, label string")
    got = splits.split_fixed(df, 20, 10).toPandas()
    assert got.id.is_unique
    assert got.groupby(["label", "part"]).size().to_dict() == {("big", "train"): 20, ("big", "val"): 10, ("small", "train"): 5, ("small", "val"): 2}
    two = splits.split_two_files(df, df.withColumn("id", F.col("id") + 1000), 5, 6, 12).toPandas()
    assert two.groupby(["label", "part"]).size().to_dict() == {
        ("big", "train"): 5, ("big", "val"): 6, ("big", "test"): 12, ("small", "train"): 5, ("small", "val"): 2, ("small", "test"): 5}


def test_ties_go_to_the_first_run(spark):
    df = spark.createDataFrame([(2, "m", 0.5, 0.9), (1, "m", 0.5, 0.9), (3, "m", 1.0, None)], "run_idx long, model_name string, data_fraction double, val_f1 double")
    assert {x.run_idx for x in runs.best_runs(df).collect()} == {1, 3}
    assert runs.best_run(df).first().run_idx == 1


def test_single_run_has_no_sample_deviation(spark):
    r = spark.createDataFrame([(1, "m_frac0.5", 3, 0.5, 0.4, 0.4, 0.4, 0.4)],
                              "run_idx long, model_fraction string, seed int, val_f1 double, test_f1 double, test_accuracy double, test_precision double, test_recall double")
    assert runs.seed_stats(r).first().test_f1_std == 0.0
    assert runs.select_for_fractions(r).first().selected_value == 0.4


def test_topic_pairs_use_the_right_labels(spark):
    df, _, _ = cloud(spark, 50, 8)
    labels = {r.id: r.label for r in df.collect()}
    got = topic_pairs.topic_pairs(df).collect()
    assert len(got) == 100
    assert all((labels[x.id] == labels[x.partner]) == bool(x.truth) and x.id != x.partner for x in got)


def test_pair_metrics_with_ties(spark):
    rows = [("a", 1, 0.9), ("b", 1, 0.5), ("c", 0, 0.5), ("d", 0, 0.1)]
    m = topic_pairs.pair_metrics(spark.createDataFrame(rows, "pair_id string, truth int, score double"), ks=(1, 2)).first()
    assert (m.auc, m.accuracy, m.best_threshold, m.precision_at_1, m.precision_at_2) == pytest.approx((0.875, 0.75, 0.5, 1.0, 1.0))


def test_round_reports(spark):
    rows = [("base", None, True, 0.1, 0.5, 0.2), ("round1", 1, False, 0.2, 0.4, 0.3), ("round2", 2, False, 0.3, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "encoder string, round int, is_baseline boolean, intra_sim double, inter_sim double, margin double")
    assert [x.trend for x in encoders.round_trend(df).orderBy("round").collect()] == ["-", "Intra up, Inter down, Margin up"]
    assert [x.note for x in encoders.round_delta(df).orderBy("round").collect()] == ["Baseline", "Intra up, Inter down, Strong improvement"]
    assert {x.metric: x.encoder for x in encoders.best_encoders(df, ["intra_sim", "inter_sim"]).collect()} == {"intra_sim": "round2", "inter_sim": "round2"}


def test_all_metrics_of_two_encoders(spark):
    from threadgrove.plans.evaluation import compare_encoders

    good = spark.createDataFrame([(i, i % 3, (np.eye(3)[i % 3] + 0.01 * (i % 5)).tolist()) for i in range(45)], VEC)
    bad, _, _ = cloud(spark, 45, 4)
    got = {x.encoder: x for x in compare_encoders({"good": (good, good), "bad": (bad, bad)}, ks=(1, 3)).collect()}
    assert got["good"].acc == 1.0 and got["good"].nmi == pytest.approx(1.0) and got["good"].mrr == 1.0
    assert got["good"].margin > got["bad"].margin and got["good"].ari > got["bad"].ari


def clustered(spark, n, seed, start=0, groups=12, dim=16):
    centres = np.random.default_rng(99).normal(size=(groups, dim))
    rng = np.random.default_rng(seed)
    y = rng.integers(0, groups, n)
    x = (centres[y] + 0.03 * rng.normal(size=(n, dim))).astype("float32")
    return spark.createDataFrame([(start + i, int(y[i]) % 3, x[i].tolist()) for i in range(n)], VEC), x.astype(float), y % 3


def test_bounds_rule_out_most_cells(spark):
    """On clustered vectors few pairs of a query and a cell meet, and the ranking is that of all pairs."""
    q, qx, _ = clustered(spark, 300, 1)
    c, cx, _ = clustered(spark, 900, 2, start=1000)
    sides = retrieval._sides(q, c, "id", "label", "embedding")
    found = retrieval.search(*sides, k=5, block=100)
    met, whole = found.visits()
    assert found.cells.groups > 3 and met < 0.25 * whole
    order = np.argsort(-np.round(unit(qx) @ unit(cx).T, retrieval.DIGITS), axis=1, kind="stable")[:, :5]
    top = retrieval._merge(found.hits, "top", 5).orderBy("query_id", "rank").toPandas()
    assert top.candidate_id.to_numpy().reshape(300, 5).tolist() == (order + 1000).tolist()


@pytest.mark.parametrize("pivots", [1, 4, 1024])
def test_retrieval_of_zero_equal_and_unlabelled_vectors(spark, pivots):
    rng = np.random.default_rng(5)
    x = np.vstack([np.zeros((3, 4)), np.ones((9, 4)), -np.ones((2, 4)), rng.normal(size=(20, 4))])
    rows = [(int(i), None if i % 7 == 0 else int(i % 4), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VEC)
    sims = np.round(unit(np.where(x.any(axis=1, keepdims=True), x, 1e-300)) @ unit(np.where(x.any(axis=1, keepdims=True), x, 1e-300)).T, 12)
    sims[~x.any(axis=1)] = sims[:, ~x.any(axis=1)] = 0
    order = np.argsort(-sims, axis=1, kind="stable")
    top = retrieval.rank_candidates(df, df, 6, block=5, pivots=pivots).orderBy("query_id", "rank").toPandas()
    assert top.candidate_id.to_numpy().reshape(len(x), 6).tolist() == order[:, :6].tolist()
    same = [[rows[a][1] is not None and rows[a][1] == rows[b][1] for b in o] for a, o in enumerate(order)]
    want = np.mean([1 / (s.index(True) + 1) if True in s else 0 for s in same])
    assert retrieval.evaluate(df, df, ks=(1,), block=5, pivots=pivots).first().mrr == pytest.approx(want)


def test_no_candidates(spark):
    q, _, _ = cloud(spark, 5)
    assert retrieval.rank_candidates(q, q.limit(0), 3).count() == 0
    assert retrieval.evaluate(q, q.limit(0), ks=(1,)).first().mrr == 0.0


def test_class_extremes_skip_most_blocks(spark):
    df, x, y = clustered(spark, 1200, 3, groups=36)
    found, visited, pairs = clustering.class_range_search(df, block=20)
    assert visited.count() < 0.5 * pairs.count()
    got = {r._l: (r.lo, r.hi) for r in found.groupBy("_l").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    for k in range(3):
        s = (unit(x[y == k]) @ unit(x[y == k]).T)[np.triu_indices((y == k).sum(), 1)]
        assert got[k] == pytest.approx((s.min(), s.max()))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5)])
def test_auction_equals_all_permutations(spark, shape):
    """Several tables at once by the auction, against the best of all permutations."""
    rng = np.random.default_rng(sum(shape))
    tables = [rng.integers(0, 12, shape) * (rng.random(shape) < 0.7) for _ in range(4)]
    rows = [(str(t), f"l{i}", f"c{j}", int(g[i, j])) for t, g in enumerate(tables) for i in range(shape[0]) for j in range(shape[1])]
    df = spark.createDataFrame(rows, "enc string, label string, cluster string, n long")
    got = {x.enc: x.accuracy for x in clustering.cluster_accuracy(df, ("enc",), dense=0).collect()}
    for t, g in enumerate(tables):
        if g.sum():
            a = g if g.shape[0] <= g.shape[1] else g.T
            best = max(sum(a[i, p[i]] for i in range(a.shape[0])) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
            assert got[str(t)] == pytest.approx(best / g.sum())



def test_kmeans_runs_share_their_passes(spark, monkeypatch):
    """The best of three runs is that of pyspark.ml with the same seeds; an iteration is one pass for all runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from threadgrove.session import stored

    r = np.random.default_rng(8)
    df = stored(spark.createDataFrame([(i, i % 4, r.normal(size=6).tolist()) for i in range(600)], "id bigint, label bigint, embedding array<double>").coalesce(1))
    fits = [KMeans(k=4, maxIter=300, seed=42 + i, tol=1e-4).fit(df.select(array_to_vector("embedding").alias("features"))).summary for i in range(3)]
    passes, step = [], clustering._lloyd_step
    monkeypatch.setattr(clustering, "_lloyd_step", lambda *a: passes.append(1) or step(*a))
    rows, inertia = clustering.kmeans_labels(df, n_init=3, normalize=False)
    best = min(fits, key=lambda s: s.trainingCost)
    assert len(passes) <= max(s.numIter for s in fits) + 1
    assert abs(inertia / best.trainingCost - 1) < 1e-6
    assert sorted(x[1] for x in rows.groupBy("cluster").count().collect()) == sorted(best.clusterSizes)


def test_dealt_queries_come_in_slices_without_what_chose_their_cells(spark, monkeypatch):
    """Few rows are handed on together, the lists of a label's cells not at all; the figures stay."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, str(i % 5), r.normal(size=6).tolist()) for i in range(300)], "id bigint, label string, embedding array<double>")
    q, c = df.filter("id < 150"), df.filter("id >= 150")
    plain = retrieval.evaluate(q, c, (1, 3), block=16).first()
    schemas, meet = [], retrieval.meet
    monkeypatch.setattr(retrieval, "DEALT_ROWS", 7)
    monkeypatch.setattr(retrieval, "meet", lambda dealt, *a: schemas.append(dealt.columns) or meet(dealt, *a))
    assert retrieval.evaluate(q, c, (1, 3), block=16).first() == plain
    assert schemas and not any(set(s) & {"_in", "_floor", "_seen"} for s in schemas)


@pytest.mark.parametrize("n", [1500, 3000])
def test_class_extremes_send_a_row_a_few_times(spark, n):
    """On vectors without clusters all pairs are compared, yet rows are sent in proportion to their number."""
    df, x, _ = cloud(spark, n, 1, classes=1)
    rows, cells, pivots = clustering._class_cells(df, "id", "label", "embedding", 64, clustering.CLASS_PIVOTS)
    pairs = clustering._cell_pairs(cells, pivots).select("_l", "cell1", "cell2")
    first, second = clustering._tiles(rows, cells, pairs, 1 << 15)
    assert first.filter("_k IS NOT NULL").count() + second.count() == (clustering.CLASS_TILES + 1) * n
    s = (unit(x) @ unit(x).T)[np.triu_indices(n, 1)]
    for tile in (1 << 15, n // 6):
        ends = clustering._extremes(rows, cells, pairs, tile).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        assert (ends.lo, ends.hi) == pytest.approx((s.min(), s.max()))


@pytest.mark.parametrize("block", [8, 64])
def test_a_query_is_sent_once_and_hands_on_k_rows(spark, block, monkeypatch):
    """On vectors without clusters a query meets all cells, yet it travels once a wave and lane, and k rows come back, however many groups there are."""
    q, qx, qy = cloud(spark, 400, 1, dim=24)
    c, cx, cy = cloud(spark, 300, 2, dim=24, start=1000)
    dealt, meet = [], retrieval.meet
    monkeypatch.setattr(retrieval, "meet", lambda d, *a: dealt.append(d) or meet(d, *a))
    found = retrieval.search(*retrieval._sides(q, c, "id", "label", "embedding"), k=5, block=block)
    met, whole = found.visits()
    assert found.cells.groups >= 300 // block and met > 0.9 * whole
    assert len(dealt) == 2 and all(400 <= d.count() <= 2 * 400 for d in dealt)  # at most two lanes here
    assert found.hits.filter("kind = 'top'").count() <= 2 * 2 * 5 * 400
    order = np.argsort(-np.round(unit(qx) @ unit(cx).T, retrieval.DIGITS), axis=1, kind="stable")
    top = retrieval._merge(found.hits, "top", 5).orderBy("query_id", "rank").toPandas()
    assert top.candidate_id.to_numpy().reshape(400, 5).tolist() == (order[:, :5] + 1000).tolist()


@pytest.mark.parametrize("n, m, block, kind", [(7, 900, 16, "string"), (300, 200, None, "bigint"), (200, 600, 32, "string")])
def test_equal_vectors_in_lanes_and_parts(spark, n, m, block, kind):
    """Few queries meet their candidates in several lanes; a vector that a third of the rows share ties with itself, smaller ids first."""
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n + m, 5)), rng.integers(0, 40, n + m)
    x[rng.random(n + m) < 0.33] = 1.0
    ids = rng.permutation(n + m)
    name = (lambda i: f"{i:05d}") if kind == "string" else int
    schema = f"id {kind}, label int, embedding array<double>"
    q = spark.createDataFrame([(name(ids[i]), int(y[i]), x[i].tolist()) for i in range(n)], schema)
    c = spark.createDataFrame([(name(ids[i]), int(y[i]), x[i].tolist()) for i in range(n, n + m)], schema)
    sims = np.round(unit(x[:n]) @ unit(x[n:]).T, retrieval.DIGITS)
    order = np.array([np.lexsort((ids[n:], -s)) for s in sims])
    found = retrieval.search(*retrieval._sides(q, c, "id", "label", "embedding"), k=6, block=block)
    assert found.grid.lanes > 1
    top = {(r.query_id, r["rank"]): (r.candidate_id, r.same) for r in retrieval._merge(found.hits, "top", 6).collect()}
    assert top == {(name(ids[i]), j + 1): (name(ids[n + order[i, j]]), bool(y[i] == y[n + order[i, j]])) for i in range(n) for j in range(6)}
    rr = {r.query_id: r.reciprocal_rank for r in retrieval.reciprocal_ranks(found, 6).collect()}
    same = y[n:][order] == y[:n, None]
    assert rr == pytest.approx({name(ids[i]): 1 / (same[i].argmax() + 1) if same[i].any() else 0.0 for i in range(n)})
