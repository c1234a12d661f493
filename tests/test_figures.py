"""Literal cases of rules that the given tables do not reach."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadgrove.functions.text import fraction_of
from threadgrove.operators import clustering, skew, splits, topic_pairs, vocabulary
from threadgrove.operators.forest import similarity_distribution, similarity_summary, similarity_variability, size_distribution
from threadgrove.operators.retrieval import _sides, precision_at_k, rank_candidates, search
from threadgrove.operators.scoring import inject_noise
from threadgrove.plans.rounds import noise_sweep, run_rounds, variant_sweep
from threadgrove.session import stored
from threadgrove.sources import embedding_store
from threadgrove.sources.tables import normalise_pairs, unreadable_pairs


def test_missing_labels_match_nothing_and_k_is_clipped(spark):
    rows = [(1, None, [1.0, 0.0]), (2, "None", [1.0, 0.1]), (3, "a", [0.9, 0.1]), (4, "a", [0.8, 0.2])]
    both = spark.createDataFrame(rows, "id bigint, label string, embedding array<double>")
    ranked = rank_candidates(both, both, 10)
    same = {(r.query_id, r.candidate_id) for r in ranked.filter("same").collect()}
    assert same == {(2, 2), (3, 3), (3, 4), (4, 3), (4, 4)}
    assert precision_at_k(ranked, 4, (10,)).first().precision == 5 / 4 / 4


def test_variants_stay_apart_and_nan_passes_nowhere(spark):
    scored = spark.createDataFrame([(0.5,), (float("nan"),), (0.1,)], "consistency_score double")
    out = variant_sweep(scored, [("linear", 0.0), ("linear", 0.0), ("threshold", 0.3)]).collect()
    assert sorted((r.variant, r.strategy, r.total, r.kept) for r in out) == [(0, "linear", 3, 2), (1, "linear", 3, 2), (2, "threshold", 3, 1)]


@pytest.mark.parametrize("pool", [(0.0, 0.1), (0.0, 0.003), (2.0, 3.0)])
def test_noise_sweep_gives_the_figures_of_every_injection(spark, pool):
    scores = np.random.default_rng(3).random(400).round(4).tolist() + [None, 0.001, 0.002]
    rows = [(i, s, f"a{i}", f"b{i}", [1.0], [1.0]) for i, s in enumerate(scores)]
    scored = spark.createDataFrame(rows, "sample_index long, consistency_score double, anchor_content string, positive_content string, anchor_probs array<double>, positive_probs array<double>")
    fractions = (0.0, 0.05, 0.3, 1.0)
    got = {r.fraction: r for r in noise_sweep(scored, fractions, pool=pool, mode="all_above_threshold").collect()}
    for f in fractions:
        want = inject_noise(scored, f, pool=pool, mode="all_above_threshold").select("consistency_score", "noise").collect()
        assert (got[f].total, got[f].replaced) == (len(want), sum(r.noise is not None for r in want))
        assert got[f].mean_score == pytest.approx(np.mean([r.consistency_score for r in want if r.consistency_score is not None]))


def test_sizes_of_billions(spark):
    trees = spark.createDataFrame([("p", 5_000_000_000), ("p", 5_000_000_002)], "post_id string, size bigint")
    row = size_distribution(trees).first()
    assert (row.total_nodes, row.std_size) == (10_000_000_002, 1.0)


def test_posts_without_a_usable_edge(spark):
    edges = spark.createDataFrame([("p", 0.5), ("p", float("nan")), ("q", None), ("q", float("nan"))], "post_id string, similarity double")
    nodes = spark.createDataFrame([("p", None), ("q", None)], "post_id string, parent_id string")
    rows = {r.post_id: r for r in similarity_distribution(edges).collect()}
    assert (rows["p"]["count"], rows["q"]["count"], rows["q"]["mean"]) == (1, 0, None)
    assert similarity_variability(similarity_distribution(edges)).first().posts == 1
    assert tuple(similarity_summary(nodes, edges).first()) == (2, 1, 1)


def test_unreadable_fraction_is_zero(spark):
    df = spark.createDataFrame([("m_frac0.1",), ("m_fracx",), ("m",)], "c string")
    assert [r[0] for r in df.select(fraction_of("c")).collect()] == [0.1, 0.0, 0.0]


def test_thousands_of_hot_keys_are_split(spark):
    left = spark.range(0, 2000 * 6).select((F.col("id") % 2000).alias("k"), F.array("id").alias("only_an_array"))
    right = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = skew.lookup(left, right, ["k"], hot_rows=2)
    assert out.count() == 12000 and out.filter("v <> 2 * k").count() == 0


def test_string_ids_and_bounded_hits(spark):
    """Ids may be strings; what leaves the tasks does not grow with the candidates."""
    def rows(name, n):
        return spark.range(n).select(F.concat(F.lit(name), "id").alias("id"), (F.col("id") % 2).cast("string").alias("label"),
                                     F.array(F.cos("id"), F.sin("id")).alias("embedding"))

    q = rows("q", 20)
    ranked = rank_candidates(q, rows("c", 50), 3, block=7)
    assert ranked.schema["candidate_id"].dataType.simpleString() == "string" and ranked.count() == 60
    assert ranked.filter("rank = 1 and substr(query_id, 2) != substr(candidate_id, 2)").count() == 0
    for n in (400, 4000):
        found = search(*_sides(q, rows("c", n), "id", "label", "embedding"), 3)
        assert found.hits.count() <= 20 * (3 + 1) * found.cells.groups * len(found.waves)


def test_noise_copy_leaves_the_round_alone_and_noise_is_carried(spark, tmp_path):
    rows = [(i, f"a{i}", f"b{i}", [1.0, 0.0], [1.0, 0.0] if i < 8 else [0.0, 1.0]) for i in range(12)]
    pairs = spark.createDataFrame(rows, "sample_index long, anchor_content string, positive_content string, "
                                        "anchor_probs array<double>, positive_probs array<double>")
    common = {"strategy": "threshold", "threshold": 0.5, "method": "simple_dot_product"}
    noise = {"fraction": 0.5, "pool": (0.0, 0.1), "mode": "all_above_threshold"}
    run_rounds(pairs, str(tmp_path), [{**common, "noise_copy": noise}, {**common, "noise": noise}])
    last = run_rounds(None, str(tmp_path), [common], start=3, spark=spark)
    out = spark.read.parquet(str(tmp_path)).groupBy("round", "variant").agg(
        F.count("noise.source_index").alias("n"), F.count(F.lit(1)).alias("rows"))
    got = {(r["round"], r.variant): (r.n, r["rows"]) for r in out.collect()}
    assert got == {(1, "main"): (0, 12), (1, "noise_eval"): (4, 12), (2, "main"): (4, 12), (3, "main"): (4, 12)}
    assert last.filter("size(training_rounds) = 3 and consistency_score < 0.5").count() == 8


def test_node_center_pairs_pass_normalisation(spark):
    rows = spark.createDataFrame([(0, "p", "r", "text", 3, "node_center"), (1, "p", None, "text", 3, "node_center")],
                                 "sample_index long, post_id string, root_id string, anchor_content string, subtree_size long, pair_type string")
    assert [r.sample_index for r in normalise_pairs(rows).collect()] == [0]
    assert unreadable_pairs(rows).first().asDict() == {"pairs": 2, "dropped": 1}


@pytest.mark.parametrize("part", [100_000, 7])
def test_many_labels_of_wide_vectors(spark, monkeypatch, part):
    """1000 labels of 256-d vectors, one of them large and one missing, against all pairs; also cut into parts."""
    monkeypatch.setattr(clustering, "GROUP_ROWS", part)
    rng = np.random.default_rng(3)
    label = np.concatenate([np.repeat(np.arange(1000), 2), np.full(300, 5)])
    x = rng.normal(size=(len(label), 256))
    rows = [(f"l{g}" if g else None, v.tolist()) for g, v in zip(label, x)]
    df = spark.createDataFrame(rows, "label string, embedding array<double>").repartition(5)
    got = {r.label: r for r in clustering.intra_class(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 1000
    for g in (0, 1, 5, 999):
        s = (u[label == g] @ u[label == g].T)[np.triu_indices((label == g).sum(), 1)]
        r = got[f"l{g}" if g else None]
        assert (r.size, r.intra_similarity) == (int((label == g).sum()), pytest.approx(s.mean()))
        assert r.intra_std == pytest.approx(s.std(), abs=1e-7)
    means = {r.label: r.mean for r in clustering.pair_means(df.withColumnRenamed("embedding", "_u"), "label").collect()}
    assert len(means) == 1000
    whole = clustering.class_separation(df).first()
    assert whole.num_classes == 1000 and whole.intra_class_similarity == pytest.approx(np.mean([r.intra_similarity for r in got.values()]))


def test_rows_are_padded_to_the_longest_of_their_batch(spark):
    df = spark.createDataFrame([(1, 0, "a b c"), (2, 0, "a"), (3, 1, ""), (4, 1, "a b"), (5, None, "a")], "id long, b long, content string")
    coded = vocabulary.encode_tokens(df, vocabulary.vocabulary(df), "id", max_len=None, pad="longest", batch="b").collect()
    assert {x.id: (len(x.input_ids), sum(x.attention_mask)) for x in coded} == {1: (3, 3), 2: (3, 1), 3: (2, 0), 4: (2, 2), 5: (1, 1)}


def test_rows_with_one_key_keep_their_own_tokens(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "c c"), (None, None), (None, "b"), (2, "x a")], "id long, content string").repartition(2)
    vocab = vocabulary.vocabulary(df.filter("id = 1"))
    at = {x.token: x.id for x in vocab.collect()}
    coded = vocabulary.encode_tokens(df, vocab, "id", pad="none").collect()
    assert sorted(((x.id or 0, x.input_ids) for x in coded)) == sorted(
        [(1, [at["a"], at["b"], at["c"]]), (1, [at["c"], at["c"]]), (0, []), (0, [at["b"]]), (2, [1, at["a"]])])
    assert vocabulary.encode_tokens(df.filter("id = 3"), vocab, "id", pad="longest").collect() == []


def test_parts_hold_few_tokens_and_each_word_once(spark):
    df = spark.createDataFrame([(i, ["w", "v", f"u{i % 3}", None]) for i in range(50)] + [(50, ["w"] * 100), (51, [])], "id long, tokens array<string>").coalesce(1)
    parts = vocabulary.dictionary_parts(df, "tokens", part_tokens=40).collect()
    assert all(len(p.words) == len(set(p.words)) and (sum(r.n for r in p.rows) <= 40 or len([r for r in p.rows if r.n]) == 1) for p in parts)
    back = {r.id: [p.words[c] for c in r.codes] for p in parts for r in p.rows}
    assert back == {r.id: r.tokens for r in df.collect()} and len({p.part for p in parts}) == len(parts)


def test_long_texts_come_in_small_batches(spark, monkeypatch):
    """Batches of texts are limited by their bytes, and only while parts are made."""
    key, cut, seen = "spark.sql.execution.arrow.maxBytesPerBatch", vocabulary.dictionary_parts, []
    before = spark.conf.get(key)
    monkeypatch.setattr(vocabulary, "dictionary_parts", lambda *a: seen.append(spark.conf.get(key)) or cut(*a))
    df = spark.createDataFrame([(i, "w " * i) for i in range(20)], "id long, content string")
    coded = vocabulary.encode_tokens(df, vocabulary.vocabulary(df), "id", pad="none").collect()
    assert {x.id: len(x.input_ids) for x in coded} == {i: i for i in range(20)}
    assert seen == [str(vocabulary.BATCH_BYTES)] and spark.conf.get(key) == before


def test_parts_are_written_and_decoded_one_at_a_time(spark, monkeypatch):
    """A row group is one part, and no aggregate holds the words of several parts; ids are those of the words."""
    kept, plain = [], vocabulary.stored
    monkeypatch.setattr(vocabulary, "stored", lambda *a, **k: kept.append(plain(*a, **k)) or kept[-1])
    cut = vocabulary.dictionary_parts
    monkeypatch.setattr(vocabulary, "dictionary_parts", lambda rows, tokens: cut(rows, tokens, 30))
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9))) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, content string").coalesce(1)
    vocab = vocabulary.vocabulary(df.filter("id < 150"), min_freq=2)
    at = {x.token: x.id for x in vocab.collect()}
    coded = vocabulary.encode_tokens(df, vocab, "id", pad="none")
    assert {x.id: x.input_ids for x in coded.collect()} == {i: [at.get(w, 1) for w in (t or "").split()] for i, t in rows}
    files = [f.removeprefix("file://").removeprefix("file:") for f in kept[-1].inputFiles()]
    groups = [(m.num_row_groups, m.num_rows) for m in (pq.ParquetFile(f).metadata for f in files)]
    assert max(n for _, n in groups) > 20 and all(g == n for g, n in groups)
    assert "collect_list" not in coded._jdf.queryExecution().toString()


def test_only_wanted_vectors_leave_the_store(spark):
    store = spark.createDataFrame([("e", f"{i:04d}", [float(i)]) for i in range(5000)], "encoder string, text_key string, embedding array<float>")
    wanted = stored(spark.createDataFrame([(f"{i:04d}",) for i in range(10)], "text_key string"))
    found = embedding_store.wanted_vectors(stored(store), wanted, "e")
    assert sorted(r.embedding[0] for r in found.collect()) == list(range(10))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("encoder")
    assert "BroadcastHashJoin" in plan[:scan] and "LeftSemi" in plan
    before_join = plan[plan.index("LeftSemi"):]
    assert "embedding" not in "".join(line for line in before_join.splitlines() if "Exchange hashpartitioning" in line)


def test_labels_are_numbered_in_order(spark):
    df = spark.createDataFrame([(x,) for x in [None, *[f"{i % 500:03d}" for i in range(1500)]]], "label string").repartition(7)
    got = {x.label: x.label_id for x in splits.label_index(df).collect()}
    assert got == {f"{i:03d}": i for i in range(500)}


def test_topic_pairs_leave_rows_without_a_label_out(spark):
    df = spark.createDataFrame([(i, None if i < 5 else i % 3, [1.0, float(i)]) for i in range(35)], "id long, label long, embedding array<double>")
    pairs = topic_pairs.topic_pairs(df).collect()
    assert len(pairs) == 60 and all(x.id >= 5 and x.partner >= 5 and (x.id % 3 == x.partner % 3) == bool(x.truth) for x in pairs)


def test_two_vectors_of_one_text_do_not_double_rows(spark, tmp_path):
    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "content string")
    make = lambda: (lambda t: np.ones((len(t), 2), np.float32))
    path = str(tmp_path / "store")
    embedding_store.add_embeddings(texts, path, "e", make).collect()
    again = embedding_store.read_store(spark, path).select("encoder", "text_key", "embedding")
    stored(again).write.mode("append").partitionBy("encoder").parquet(path)
    assert embedding_store.add_embeddings(texts, path, "e", make).count() == 3
