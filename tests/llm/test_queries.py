"""Registered corpus queries against SQL, the pipeline stage by stage against its parts, and the stages' columns."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.oracle import compare, connect
from threadgrove.llm import simhash
from threadgrove.llm.queries import QUERIES, SQL
from threadgrove.session import stored

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PIPELINE_DIR = "/root/testdata/sf0.01"  # the smallest with enough labels for every stage to act


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    assert compare(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) == ""


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{PIPELINE_DIR}/documents.parquet")
    scored = QUERIES["op8_toxicity_neighbours"](spark, PIPELINE_DIR).collect()
    columns, out = docs.columns, {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = out[name] = stored(stage(spark, kept, PIPELINE_DIR))
        assert name == "packing" or kept.columns == columns
    first, second, third, fourth, last = ({x.doc_id: x for x in d.collect()} for d in out.values())
    gone = {x.doc_id for x in docs.collect()} - set(first)
    assert gone and gone == {x.doc_id for x in scored if x.predicted}
    found = {x.doc_id: x for x in simhash.near_duplicates(out["toxicity"]).collect()}
    assert set(second) == {x.component_id for x in found.values()} and len(second) < len(first)
    assert all(int(found[d].fingerprint, 16) == brute.simhash(first[d].text) for d in list(first)[::9])
    assert set(third) == set(second) and all(third[d].text == second[d].text or "[SECRET]" in third[d].text for d in third)
    sizes, taken = Counter(), Counter()
    for x in third.values():
        sizes[x.source] += len(brute.BLANK.findall(x.text or ""))
    for x in out["source_mixing"].collect():
        taken[x.source] += len(brute.BLANK.findall(x.text or ""))
    assert all(abs(taken[s] - t) < 1.001 for s, t in brute.mix_targets(sizes).items())
    copies = Counter(x.doc_id for x in out["source_mixing"].collect())
    assert Counter(x.doc_id for x in out["packing"].collect() if x.start == 0) == copies
