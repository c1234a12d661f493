"""Conversation tries, benchmark decontamination and periodic runs against brute force, on awkward rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import BLANK
from threadgrove.llm import conversation_trie, decontamination, periodic, queries

# ---- tries ----------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, p1 string, words string"


def turns_of(rows):
    """conv_id -> [(role, text)] in the order of turns."""
    out = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            out[c].append(((t is not None, t or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in out.items()}


def brute_trie(convs):
    """(conv_id, depth) -> parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    out = {}
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(BLANK.findall(n[-1][1])) for n in below if n)
        text = ",".join(map(str, sorted(ends[node])))
        out[(min(who), len(node))] = (min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved,
                                      hashlib.sha256(text.encode()).hexdigest())
    return out


def as_dict(df):
    return {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in df.collect()}


def conversations():
    r = random.Random(4)
    said = ["hi", "hi there", None, "", "a b\tc", "Hi", "été x"]
    rows = []
    for c in [*range(-25, 60), 1000, 10**12]:
        for t in range(r.choice([1, 2, 3, 4, 6])):
            rows.append((c, None if r.random() < 0.05 else r.choice([t, t, 0]), r.choice(["user", "user", None, "bot"]) if t else "user", r.choice(said[:3 + t])))
    rows += [(7, 1, "user", "hi"), (7, 1, "user", "hi"), (None, 0, "user", "hi"), (3, 2, "bot", "x " * 5000)]
    rows += [(c, 0, "user", "lone") for c in range(205, 214)]
    return [(*x, "d", "p", "w") for x in rows]


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert as_dict(conversation_trie.prefix_trie(df)) == brute_trie(turns_of(rows))


def test_rebuilt_trie_equals_brute_force(spark):
    rows = conversations()
    own = turns_of(rows)
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + seq[h:]
    assert any(not x for x in built.values())
    df = spark.createDataFrame(rows, TURNS)
    assert as_dict(conversation_trie.trie(*queries.rebuilt(conversation_trie.numbered(df)))) == brute_trie(built)


def test_long_conversations_in_bands_and_cells(spark, monkeypatch):
    """Chains longer than a cell and several bands, with a copy that leaves late, and a queue that spills."""
    monkeypatch.setattr(conversation_trie, "CELL", 8)
    long = [(1, i, "u", f"t{i}") for i in range(50)]
    rows = long + [(2, *x[1:]) for x in long[:40]] + [(2, 60, "u", "other words")] + [(3, *x[1:]) for x in long] + [(i, 0, "u", f"x{i % 9}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    turns = conversation_trie.numbered(df)
    got = conversation_trie.trie(turns, turns.select("conv_id").distinct(), band=8, queue=3)
    assert as_dict(got) == brute_trie(turns_of(rows))


def test_empty_trie(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_spilling_queue():
    r = random.Random(1)
    for most in (2, 7, 1000):
        q, waiting, out = conversation_trie.SpillingQueue(most), [], []
        for _ in range(3000):
            if waiting and r.random() < 0.4:
                least = min(waiting)
                assert q.first() == least and q.pop() == least
                waiting.remove(least)
            else:
                item = (r.randrange(50), r.randrange(9))
                q.push(item)
                waiting.append(item)
        while q.first() is not None:
            out.append(q.pop())
        assert out == sorted(waiting)


# ---- decontamination ------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, width=10):
    out = []
    for d, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            x = split(t)
            if item is None or not x:
                continue
            size = min(width, len(x))
            wins = {tuple(x[i:i + size]) for i in range(len(x) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return Counter(out)


def texts():
    r = random.Random(6)
    word = lambda: r.choice(["a", "b", "the", "Été", "X9", "中", "naïve", "end"])
    prose = lambda n: " ".join(word() + r.choice(["", ",", " -"]) for _ in range(n))
    items = [(i, prose(r.choice([0, 1, 2, 3, 4, 9, 10, 11, 30]))) for i in range(25)]
    items += [(3, prose(14)), (50, items[7][1]), (51, None), (None, prose(12)), (52, "unheard words in no document at all here ever")]
    docs = [(i, prose(r.randint(0, 60)) + " " + (r.choice(items)[1] or "").upper() + "! " + prose(r.randint(0, 9))) for i in range(60)]
    docs += [(None, items[5][1]), (70, None), (71, ""), (72, "..."), (5, docs[5][1]), (73, prose(20_000)), (74, (items[8][1] or "") * 3)]
    return docs, items


def test_decontamination_equals_brute_force(spark):
    docs, items = texts()
    d = spark.createDataFrame([(*x, "r", "w", "n") for x in docs], "doc_id bigint, text string, row string, words string, n_words string").repartition(4)
    b = spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, text string, token string")
    out = decontamination.decontaminate(d, b).collect()
    assert Counter((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in out) == brute_hits(docs, items)
    for x in out:
        assert x.n_hit == len({p for s in x.spans for p in range(s.start, s.start + s.length)})


def test_decontamination_of_nothing(spark):
    docs, items = texts()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    clean = decontamination.decontaminate(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and {x.n_hit for x in clean} == {0}


def test_prefix_token_is_the_rarest(spark):
    """A window whose shingles all occur is met on the rarest of them; one with an unknown shingle is met on none."""
    item = "one two three four five six seven eight nine ten"
    docs = [(i, "one two three four " + "six seven eight nine ten " * (i < 5)) for i in range(20)] + [(99, item)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    tokens = decontamination.tokens(decontamination.item_windows(spark.createDataFrame([(1, item), (2, "what no one has ever said to any one at all here")], "item_id bigint, text string"), 10).select("window"))
    p = decontamination.prefixes(tokens, decontamination.occurrence_counts(d, tokens)).collect()
    assert len(p) == 1 and p[0].window == item.split() and p[0].offset in (1, 2, 3, 4)


# ---- periodic runs --------------------------------------------------------------------------------

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            s = i - q
            if j - s >= max(6, 4 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, j)) for p in range(1, q)):
                out.append((s, j - s, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("short", [10, 2048])
def test_runs_equal_brute_force(monkeypatch, short):
    monkeypatch.setattr(periodic, "TABLE_WORDS", short)
    monkeypatch.setattr(periodic, "BLOCK", 16)
    table, r = periodic.Places(), random.Random(2)
    for _ in range(600):
        k, n, w = r.choice([1, 2, 3, 5]), r.randint(0, 120), []
        while len(w) < n:
            w += ([r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(1, 9))[:r.randint(1, 60)]
        assert periodic.find_runs(np.array(w[:n], np.int32), table) == brute_runs(w[:n])


def test_frequent_words_open_few_diagonals():
    """A word in every place, or in every other, opens one diagonal; all its earlier places are not gone through."""
    for w in (np.zeros(20_000, np.int32), np.arange(20_000, dtype=np.int32) % 2):
        runs = periodic.find_runs(w, periodic.Places())
        assert runs == [(0, 20_000, 1 + int(w.any()))]
    i, lag = periodic.places(0, 4096, 1024)
    assert len(i) < 4096 * 8 and (i % lag == 0).all()


def test_periodic_runs(spark):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["a", "b", "é", "c d"]) + r.choice(["", "", "\n", "\t "]) for _ in range(n))
    docs = [(i, prose(r.randint(0, 200))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n\x0b"), (None, "x y " * 40), (103, "x y " * 40), (103, "x y " * 40), (104, prose(3000)), (105, "z " * 9000)]
    df = spark.createDataFrame([(*x, "r", "s") for x in docs], "doc_id bigint, text string, runs string, start string").repartition(3)
    want = Counter()
    for d, t in docs:
        w = BLANK.findall(t or "")
        runs = brute_runs(w) if len(w) < 4000 else [(0, 9000, 1)]
        want[(d, tuple(runs), brute_collapsed(w, runs))] += 1
    got = Counter((x.doc_id, tuple(map(tuple, x.runs)), x.collapsed) for x in periodic.periodic_runs(df).collect())
    assert got == want
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_planted_runs(spark):
    docs = [(i, " ".join(f"w{k}" for k in range(i % 97))) for i in range(300)] + [(None, "a b"), (301, None)]
    out = queries.with_planted_runs(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    for (d, t), x in zip(docs, out):
        w = BLANK.findall(t or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [v if i < a else w[a + (i - a) % p] for i, v in enumerate(w)]
        assert BLANK.findall(x.text or "") == w


def test_op13_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    planted = {x.doc_id: x.text for x in queries.with_planted_runs(docs).collect()}
    seen = 0
    for x in queries.QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect():
        w = BLANK.findall(planted[x.doc_id] or "")
        if len(w) > 500:
            continue
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_words_of_items(spark):
    docs, items = texts()
    df = spark.createDataFrame(docs + items, "id bigint, text string")
    assert all(x.w == split(x.text) for x in df.select("text", decontamination.words(F.col("text")).alias("w")).collect())
