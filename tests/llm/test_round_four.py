"""What this round mended: texts of decontamination read once, toxicity in bounded memory."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_round_three import brute_hits
from threadgrove.llm import decontamination, toxicity


@pytest.mark.parametrize("repeats", [0, 3])
def test_decontamination_reads_documents_once(spark, monkeypatch, repeats):
    """Texts are cut into words in one scan; rows that hit everywhere, whose words are stored whole, give the same as rows that hit seldom."""
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(i, "far from it all " * (i % 5) * 8 + item + " and so on" * i + f" {item}" * repeats) for i in range(12)] + [(99, None), (100, "three four five six"), (101, "far from it all " * 200 + item)]
    items = [(1, item), (2, "and so on and so on and so on and so on"), (3, "on so")]
    scans = []
    words = decontamination.words
    monkeypatch.setattr(decontamination, "words", lambda text: (scans.append(text), words(text))[1])
    df, benchmark = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    out = decontamination.decontaminate(df, benchmark).collect()
    assert Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in out) == brute_hits(docs, items)
    assert len(scans) == 2  # documents and items
    kinds = decontamination.hits(df, decontamination.tokens(decontamination.item_windows(benchmark, 10).select("window")), 6).collect()
    assert {x.words is None for x in kinds if x.hits} == {True, False}


def test_toxicity_works_on_few_postings_at_once(monkeypatch):
    """Terms of examples are held once; long texts are worked on in parts, with the same scores and evidence."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    texts = [" ".join(r.choices(words, k=80 if i % 50 else 3000) + ["idiot"] * (i % 2)) for i in range(200)]
    monkeypatch.setattr(toxicity, "COMMON", 16)
    held = toxicity.Counted(map(toxicity.term_counts, texts))
    assert len(held.number) == len({t for text in texts for t in toxicity.term_counts(text)}) and len(held.term) == held.ends[-1]
    index = toxicity.build(list(range(200)), held, np.arange(200) % 2)
    sizes, ranges = [], toxicity.ranges
    monkeypatch.setattr(toxicity, "ranges", lambda a, b: (sizes.append(int((b - a).sum())), ranges(a, b))[1])
    whole, most = list(toxicity.Scorer(index)(texts)), max(sizes)
    monkeypatch.setattr(toxicity, "POSTINGS_HELD", 1 << 12)
    monkeypatch.setattr(toxicity, "CHARS_HELD", 1 << 12)
    sizes.clear()
    few = list(toxicity.Scorer(index)(texts))
    assert [s for s, _ in few] == [s for s, _ in whole] and all((a[1] == b[1]).all() for a, b in zip(few, whole))
    assert max(sizes) * 4 < most
