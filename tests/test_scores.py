"""Text rules, noise, weights and history on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from threadgrove.functions import text
from threadgrove.functions.consistency import consistency, softmax
from threadgrove.operators import infonce, pairs, scoring, vocabulary, weights
from threadgrove.plans import rounds


def test_clean_text(spark):
    cases = {"[笑哭] @bob 小米手机 hello": "hello", "a[x]b[y]": "ab", "OPPO Reno　": "Reno", "a\n[x\ny]": "a\n[x\ny]", None: "",
             "use GTNEO5 now": "use  now", "@only": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.filter(text.clean_text("t") != F.col("want")).collect() == []
    kept = spark.createDataFrame([("a pro b",)], "t string").select(text.clean_text("t", []).alias("x")).first().x
    assert kept == "a pro b"


def test_small_text_rules(spark):
    df = spark.createDataFrame([("m_frac0.1", "a/sim_0.75/b"), ("m", "x"), ("a_frac1_frac2", "sim_1")], "k string, p string")
    got = df.select(text.fraction_of("k").alias("f"), text.threshold_of_path("p").alias("t")).collect()
    assert [(x.f, x.t) for x in got] == [(0.1, 0.75), (0.0, None), (0.0, 1.0)]
    long = spark.createDataFrame([("x" * 100,), ("x" * 101,)], "t string").select(text.preview("t").alias("p")).collect()
    assert [len(x.p) for x in long] == [100, 103]


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a a"), (2, "a c"), (3, "  ")], "id long, content string")
    vocab = vocabulary.vocabulary(df)
    ids = {x.token: x.id for x in vocab.collect()}
    assert ids["a"] == 2 and sorted(ids.values()) == [2, 3, 4]
    got = {x.id: (x.input_ids, x.attention_mask) for x in vocabulary.encode_tokens(df, vocab.filter("token != 'c'"), "id", max_len=2).collect()}
    assert got == {1: ([ids["b"], 2], [1, 1]), 2: ([2, 1], [1, 1]), 3: ([0, 0], [0, 0])}


def probs(spark, *rows):
    return spark.createDataFrame(rows, "p array<double>, q array<double>")


@pytest.mark.parametrize("method,want", [("simple_dot_product", 0.5), ("cosine_similarity", (0.5 / math.sqrt(0.5) + 1) / 2),
                                         ("prediction_agreement", 0.5), ("confidence_weighted_dot_product", 0.0)])
def test_consistency(spark, method, want):
    got = probs(spark, ([0.5, 0.5], [1.0, 0.0]), (None, [1.0, 0.0])).select(consistency("p", "q", method).alias("s")).collect()
    assert got[0].s == pytest.approx(want, abs=1e-6) and got[1].s == 0.0


def test_unknown_method_and_softmax(spark):
    with pytest.raises(ValueError):
        consistency("p", "q", "other")
    x = spark.createDataFrame([([1000.0, 1000.0],)], "l array<double>").select(softmax("l").alias("s")).first().s
    assert x == [0.5, 0.5]


SCORED = "sample_index long, anchor_content string, positive_content string, anchor_probs array<double>, positive_probs array<double>, consistency_score double, dataset_type string"


def scored(spark, scores):
    return spark.createDataFrame([(i, f"a{i}", f"p{i}", [s], [s], s, "dataset1") for i, s in enumerate(scores)], SCORED)


def test_noise_reuses_an_exhausted_pool(spark):
    df = scored(spark, [0.0, 0.005, 0.5, 0.55, 0.7, 0.9, 1.0, 0.2])
    out = {x.sample_index: x for x in scoring.inject_noise(df, 1.0).collect()}
    hit = {i for i, x in out.items() if x.noise is not None}
    assert hit == {2, 3, 4, 5, 6}
    used = [out[i].noise.source_index for i in hit]
    assert sorted(used.count(s) for s in (0, 1)) == [2, 3]
    for i in hit:
        src = out[i].noise.source_index
        assert (out[i].anchor_content, out[i].positive_content) == (f"a{src}", f"p{src}")
        assert out[i].consistency_score == out[i].noise.replacement_score
    assert out[5].noise.group == "0.80-1.00" and out[5].noise.original_score == 0.9


def test_noise_counts_and_statuses(spark):
    df = scored(spark, [0.0] * 3 + [0.5] * 7 + [0.9] * 4)

    def status(frame, fraction, **kw):
        noisy = scoring.inject_noise(frame, fraction, **kw)
        keep = {k: v for k, v in kw.items() if k in ("pool", "mode", "bins")}
        return tuple(scoring.noise_status(frame, noisy, fraction, **keep).first())

    assert status(df, 0.3) == ("applied", math.ceil(7 * 0.3) + math.ceil(4 * 0.3), 3)
    assert status(df, 0.0)[0] == "skipped_fraction_0"
    assert status(df, 0.3, pool=(0.95, 0.99))[0] == "skipped_empty_pool"
    assert status(df, 0.3, bins=[])[0] == "skipped_empty_targets"
    assert status(df, 0.3, bins=[(0.6, 0.7)])[0] == "skipped_no_replacements"
    assert status(df, 0.5, mode="all_above_threshold", threshold=0.8)[:2] == ("applied", 2)


SCORES = [0.1, 0.39, 0.4, 0.6, 0.8, 1.0, -0.01]


@pytest.mark.parametrize("strategy,t,want", [
    ("linear", 0.4, [0, 0, 0.4, 0.6, 0.8, 1.0, 0]), ("linear", 1.0, [0, 0, 0.4, 0.6, 0.8, 1.0, 0]),
    ("linear", "bad", [0, 0, 0.4, 0.6, 0.8, 1.0, 0]), ("threshold", 1.0, [0, 0, 0, 0, 0, 1, 0]),
    ("threshold", 0.0, [1, 1, 1, 1, 1, 1, 0]), ("tiered", 0.0, [0, 0, 0.5, 0.7, 0.9, 0.9, 0])])
def test_weights(spark, strategy, t, want):
    got = weights.weights(scored(spark, SCORES), strategy, t).orderBy("sample_index").collect()
    assert [x.sample_weight for x in got] == pytest.approx(want)


def test_weights_keep_all_when_nothing_passes(spark):
    low = scored(spark, [0.1, 0.2])
    assert [x.sample_weight for x in weights.weights(low, "linear", 0.5).orderBy("sample_index").collect()] == [0.1, 0.2]
    assert [x.sample_weight for x in weights.weights(low, "threshold", 0.5).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        weights.weights(low, "other")


def test_history_keeps_one_entry_per_round(spark):
    df = weights.weights(scored(spark, [0.2, 0.9]), "threshold", 0.5)
    twice = weights.append_history(weights.append_history(df, 1, "threshold", 0.5), 1, "threshold", 0.6)
    rows = twice.orderBy("sample_index").collect()
    assert [list(x.training_rounds) for x in rows] == [["round_1"], ["round_1"]]
    assert rows[1].filter_history["round_1"].threshold == 0.6
    assert [x.last_trained_round for x in rows] == [None, 1]


def test_a_round_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "rounds")
    df = scored(spark, [0.2, 0.9]).drop("consistency_score")
    for _ in range(2):
        rounds.write_round(rounds.curation_round(df, 1, "threshold", 0.5, "simple_dot_product"), path, 1)
    assert rounds.read_round(spark, path, 1).count() == 2


def test_negatives_come_from_other_posts(spark):
    nodes = spark.createDataFrame([("P", "P", None, "x"), ("P", "a", "P", "pa"), ("Q", "b", "Q", "qb"), ("Q", "c", "Q", ""), ("R", "d", "R", "rd")],
                                  "post_id string, comment_id string, parent_id string, content string")
    want = spark.createDataFrame([(i, "P" if i % 2 else "Q") for i in range(40)], "sample_index long, post_id string")
    got = pairs.cross_thread_negatives(want, nodes, n=2).collect()
    assert len(got) == 80 and all(x.negative_post_id != x.post_id and x.negative_content != "" for x in got)
    assert {x.negative_content for x in got if x.post_id == "Q"} == {"pa", "rd"}
    alone = pairs.cross_thread_negatives(want.filter("post_id = 'P'"), nodes.filter("post_id = 'P'"), n=1).collect()
    assert {x.negative_content for x in alone} == {"<unk>"}


def test_filtered_negatives_do_not_repeat_inside_a_batch(spark):
    pool = scored(spark, [0.0] * 5).select("sample_index", "anchor_content", "positive_content")
    batches = spark.createDataFrame([(i, 8) for i in range(20)] + [(20, 1)], "batch_id long, batch_size long")
    got = weights.filtered_negatives(batches, pool, 1.0).toPandas()
    per = got.groupby("batch_id").sample_index
    assert (per.nunique() == per.size()).all() and per.size().to_dict() == {**{i: 5 for i in range(20)}, 20: 1}


def test_losses_of_small_batches(spark):
    one = spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0])], "batch_id long, position long, anchor array<double>, positive array<double>")
    assert infonce.in_batch(one).first().loss == pytest.approx(0.0)
    p = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [1.0, 0.0])], "sample_index long, anchor array<double>, positive array<double>")
    n = spark.createDataFrame([(1, [0.0, 1.0])], "sample_index long, negative array<double>")
    got = {x.sample_index: x.loss for x in infonce.explicit(p, n, temperature=1.0).collect()}
    assert got[1] == pytest.approx(math.log(math.e + 1) - 1) and got[2] == 0.0


@pytest.mark.parametrize("strategy,column", [("comment_reply", "child_id"), ("node_center", "node_id"), ("single_text", "comment_id")])
def test_threads_to_pairs(spark, strategy, column):
    from threadgrove.plans.curation import threads_to_pairs

    posts = spark.createDataFrame([("P", "title", "post")], "note_id string, title string, content string")
    rows = [("A", "P", "0", "first text", 1), ("B", "P", "A", "second text", 2), ("C", "P", "B", "third text", 3), ("D", "P", "A", "tiny", 4)]
    comments = spark.createDataFrame(rows, "comment_id string, note_id string, parent_comment_id string, content string, seq long")
    vecs = spark.createDataFrame([("P", c, [1.0, 0.0]) for c in "ABCD"], "post_id string, comment_id string, embedding array<float>")
    got = threads_to_pairs(posts, comments, vecs, 0.5, strategy).collect()
    assert {x[column] for x in got} == ({"B", "C"} if strategy == "comment_reply" else {"A", "B", "C"})
    assert sorted(x.sample_index for x in got) == list(range(len(got)))
    with pytest.raises(ValueError):
        threads_to_pairs(posts, comments, vecs, 0.5, "other")


def test_cluster_sessions_must_name_a_shared_folder(monkeypatch):
    from threadgrove import session

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///x/"
    assert session.shared_dir(Session()) == "hdfs:///x"


def test_rounds_on_written_tables_store_nothing_more(spark, monkeypatch):
    """A written table is scored where it is read; the result is that of the stored scores."""
    from threadgrove.plans import rounds
    from threadgrove.session import stored

    rows = [(i, f"a{i}", f"b{i}", [1 - p, p], [1.0, 0.0]) for i, p in enumerate(x / 40 for x in range(41))]
    df = stored(spark.createDataFrame(rows, "sample_index bigint, anchor_content string, positive_content string, anchor_probs array<double>, positive_probs array<double>"))
    given = {"strategy": "threshold", "threshold": 0.5, "method": "simple_dot_product", "noise": {"fraction": 0.3}}
    plain = rounds.curation_round(df, 2, **given).select("sample_index", "anchor_content", "consistency_score", "sample_weight", "noise").orderBy("sample_index").collect()
    calls = []
    monkeypatch.setattr(rounds, "stored", lambda x: calls.append(x) or stored(x))
    again = rounds.curation_round(df, 2, **given, written=True).select("sample_index", "anchor_content", "consistency_score", "sample_weight", "noise").orderBy("sample_index").collect()
    assert not calls and again == plain and any(x.noise for x in plain)


def test_probabilities_by_key(spark):
    """With a key or without: equal rows, equal and missing texts get the same classes."""
    from threadgrove.operators.scoring import attach_probabilities
    from threadgrove.queries.base import text_classes
    from threadgrove.session import stored

    df = stored(spark.createDataFrame([(1, "aa", "ee"), (2, "aa", None), (3, None, "aa"), (4, "ee", "aa")], "id bigint, anchor_content string, positive_content string"))
    keyed, numbered = [{x.id: x for x in attach_probabilities(df, text_classes, key=k).collect()} for k in ("id", None)]
    assert keyed == numbered and keyed[2].positive_probs is None and keyed[1].anchor_probs == keyed[4].positive_probs
    twice = attach_probabilities(df.unionAll(df), text_classes)
    assert twice.count() == 8 and twice.columns == [*df.columns, "anchor_probs", "positive_probs"]


def test_stored_tables_are_zstd(spark):
    import pyarrow.parquet as pq
    from pathlib import Path

    from threadgrove.session import stored

    file = stored(spark.range(10).coalesce(1)).inputFiles()[0].removeprefix("file://")
    assert Path(file).exists() and pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


def test_centre_chunks_read_written_members(spark):
    """Texts are not made again for the counts and the rows of the ranks."""
    from pyspark.sql import functions as F
    from threadgrove.operators import pairs

    members = spark.range(10).select(F.lit("p").alias("post_id"), F.lit("r").alias("root_id"), F.col("id").alias("seq"),
                                     F.concat(F.lit("c"), "id").alias("node_id"), F.soundex(F.concat(F.lit("t"), "id")).alias("content"))
    chunks = pairs.center_text_chunks(members, 3)
    assert "soundex" not in chunks._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(len(x.positive_content_list) for x in chunks.collect()) == [1, 3, 3, 3]


def test_digest_of_padded_ids(spark):
    import hashlib

    from threadgrove.queries.texts import _digest, _used

    rows = [([5, 6, 0, 0], [1, 1, 0, 0]), ([5, 6], [1, 1]), ([0, 0], [0, 0]), ([], []), ([5, 7], [1, 0]), ([0, 5], [1, 1])]
    df = spark.createDataFrame(rows, "i array<bigint>, m array<bigint>").coalesce(1)
    got = df.select("i", "m", _digest("i", "m").alias("d"), _used("m").alias("u")).collect()
    assert all(x.d == hashlib.md5(",".join(map(str, x.i)).encode()).hexdigest() and x.u == sum(x.m) for x in got)
