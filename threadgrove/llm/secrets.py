"""Secrets in texts: pattern candidates, and a random forest that removes false positives.

Candidates are runs of 12 or more token characters that hold a digit, and whatever their length and characters: values
after a credential's name, passwords in URLs, keys of an issued shape and lines of private keys. A forest trained from
labelled findings scores each by its length, character transitions, dictionary coverage, whether it stands in a path, and neighbouring words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadgrove.llm.common import stratified_sample, texts
from threadgrove.session import stored

TOKEN = "A-Za-z0-9+/=_.@\\-"
CANDIDATE = re.compile(rf"(?<![{TOKEN}])(?=[{TOKEN}]*[0-9])[{TOKEN}]{{12,}}")
# For Java's matcher: the same, used to leave texts without candidates alone.
HAS_RUN = rf"(?<![{TOKEN}])(?=[{TOKEN.replace('0-9', '')}]*+[0-9])[{TOKEN}]{{12,}}"
ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)[\"']?\s*[=:]+>?\s*[\"']?$")
# Names that credentials are assigned to, and shapes of issued keys.
CREDENTIAL_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "private_key", "auth", "credential")
SHAPES = (r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
          r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}")
ISSUED = re.compile(SHAPES)
# A credential's name as a part of a name (not "author"), then a value up to a blank or quote. Same for Java's matcher.
NAME = rf"(?i:{'|'.join(CREDENTIAL_NAMES)})(?i:s?)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))[A-Za-z0-9_]*[\"']?[ \t]*[=:]+>?[ \t]*[\"']?"
IN_URL = r"://[^\s/:@\"']*:"
BEARER = re.compile(r"(?i)\bbearer[ \t]+$")
PRIVATE = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
PRIVATE_KEY = re.compile(PRIVATE + r"((?:[A-Za-z0-9+/=\s,:\\]|-(?!----))*)(?:-----END|$)")
KEY_LENGTH = 16384
NAMED = re.compile(rf"(?a:{NAME}([^\s\"']+)|{IN_URL}([^\s/@\"']+)@|(?<![A-Za-z0-9])({SHAPES}))")
HAS_NAMED = rf"{NAME}[^\s\"']|{IN_URL}[^\s/@\"']+@|{SHAPES}|{PRIVATE}"
# What is not a value: a bare small number or a plain literal; without quotes, a variable, path, reference or call.
NO_VALUE = re.compile(r"\d{1,5}|(?i:true|false|null|none|nil|undefined)|\W+")
REFERENCE = re.compile(r"\$\{?[A-Za-z_]\w*\}?|<.*>|\{.*|%.*%|/[\w./-]*|[\w.]+[(\[]|[\w.]+\(.*\)|[\w.]+\[.*\]")
HAS_CANDIDATE = f"{HAS_RUN}|{HAS_NAMED}"
WORD_SLOTS = 24
NEIGHBOURS = 3
CONTEXT = 80
DICTIONARY_WORDS = 20_000
TREES = 24
DEPTH = 8
MASK = "[SECRET]"


def classes(value: str) -> str:
    return "".join("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value)


def split_value(candidate: str) -> int:
    """Where the value starts in a candidate such as name=value; 0 if there is no name."""
    at = candidate.find("=")
    return at + 1 if 0 < at < len(candidate) - 8 and candidate[:at].replace("_", "").isalpha() else 0


def features(text: str, start: int, end: int, dictionary: frozenset[str]) -> list[float]:
    """Figures on the value text[start:end] and on what surrounds it."""
    value = text[start:end]
    kinds = classes(value)
    n = len(value)
    turns = Counter(zip(kinds, kinds[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    covered = sum(len(w) for w in re.findall(r"[a-z]{4,}", value.lower()) if w in dictionary)
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    name = ASSIGNED.search(before)
    out = [n, kinds.count("d") / n, kinds.count("l") / n, kinds.count("u") / n, kinds.count("o") / n, entropy, covered / n,
           float(bool(re.fullmatch(r"[0-9a-f]+", value))), float("@" in value), float(value.count(".")),
           float("/" in value or before.endswith(("/", "\\")) or "://" in before[-40:]), float(after[:1] in "/\\" and bool(after)),
           float(name is not None), float(name is not None and any(c in name[1].lower() for c in CREDENTIAL_NAMES)), float(before[-1:] in "\"'" and bool(before))]
    out += [sum(turns[a, b] for a, b in turns if a + b in (ab, ab[::-1])) / max(1, n - 1) for ab in ("dl", "du", "lu", "do", "lo", "uo")]
    slots = [0.0] * WORD_SLOTS
    near = re.findall(r"\w+", before)[-NEIGHBOURS:] + re.findall(r"\w+", after)[:NEIGHBOURS]
    for word in near:
        slots[sum(map(ord, word.lower())) * 31 % WORD_SLOTS] = 1.0
    return out + [float(x) for x in special(text, start, end)] + [float(bool(NO_VALUE.fullmatch(value))), float(bool(REFERENCE.fullmatch(value)))] + slots


def named(text: str) -> list[tuple[int, int]]:
    """Values after a credential's name, passwords in URLs, issued keys and lines of private keys; ascending, apart."""
    found = []
    for m in NAMED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 1 and text[start - 1:start] not in ("'", '"'):
            end = start + len(text[start:end].rstrip(".,;"))
        if end > start:
            found.append((start, end))
    if "PRIVATE KEY-----" in text:
        keys = [(m.start(1) + x.start(), m.start(1) + x.end()) for m in PRIVATE_KEY.finditer(text) for x in re.finditer(r"\S+", m[1])]
        found = sorted(keys + [(s, e) for s, e in found if all(e <= a or s >= b for a, b in keys)])
    return found


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every candidate, ascending, apart: named values whole, and of other runs what is outside of these."""
    known = named(text)
    rest, at = [], 0
    for m in CANDIDATE.finditer(text):
        first, last = m.start() + split_value(m.group()), m.end()
        while at < len(known) and known[at][1] <= first:
            at += 1
        i = at
        while first < last:
            end = min(last, known[i][0]) if i < len(known) else last
            value = text[first:end].rstrip(".=")
            if len(value) >= 8 and any(c.isdigit() for c in value):
                rest.append((first, first + len(value)))
            first = max(first, known[i][1]) if end < last else last
            i += 1
    yield from sorted(known + rest)


def in_private_key(text: str, start: int) -> bool:
    """Whether a private key was begun, and not ended, within the KEY_LENGTH characters before."""
    begun = text.rfind("PRIVATE KEY-----", max(0, start - KEY_LENGTH), start)
    return begun >= 0 and text.rfind("-----BEGIN", max(0, begun - 40), begun) >= 0 and text.find("-----END", begun, start) < 0


def special(text: str, start: int, end: int) -> tuple[bool, ...]:
    """Issued shape, after Bearer, password in a URL, line of a private key."""
    before = text[max(0, start - CONTEXT):start]
    return (bool(ISSUED.fullmatch(text, start, end)), bool(BEARER.search(before)),
            text[end:end + 1] == "@" and bool(re.search(IN_URL + "$", before)), in_private_key(text, start))


def looks_issued(text: str, start: int, end: int) -> int:
    """The label rule used where no reviewed findings are at hand: 1 for a key of an issued shape, a value assigned to a
    credential's name, a token after Bearer, a password in a URL or a line of a private key, 0 else."""
    if any(special(text, start, end)):
        return 1
    name = ASSIGNED.search(text[max(0, start - CONTEXT):start])
    if name is None or not any(c in name[1].lower() for c in CREDENTIAL_NAMES):
        return 0
    value, quoted = text[start:end], text[start - 1] in "\"'"
    return int(not NO_VALUE.fullmatch(value) and (quoted or not REFERENCE.fullmatch(value)))


def dictionary_of(documents: DataFrame, most: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The commonest words of four or more letters a-z, counted over all documents; equal counts in order of the words.

    The smallest count that can be among them is found first, so that only words which reach it are sorted.
    """
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    counted = stored(documents.select(words).filter(F.length("word") >= 4).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    above = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).select("n", F.coalesce(above, F.lit(0)).alias("above"))
    least = sizes.filter(F.col("above") < most).agg(F.coalesce(F.min("n"), F.lit(1))).first()[0]
    top = stored(counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most))
    return frozenset(r["word"] for r in top.collect())


def find_candidates(documents: DataFrame, dictionary: frozenset[str], key: str = "doc_id") -> DataFrame:
    """`key`, start, length, shape, features, issued (label rule) of every candidate; positions count code points."""
    kind = documents.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows = [], []
            for i, text in enumerate(texts(b.column("text"))):
                for s, e in candidates(text):
                    owner.append(i)
                    rows.append((s, e - s, re.sub(r"(.)\1+", r"\1+", classes(text[s:e]))[:64], features(text, s, e, dictionary), looks_issued(text, s, e)))
            s, n, shape, x, y = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(owner, pa.int64())), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(shape, pa.string()),
                 pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], [key, "start", "length", "shape", "features", "issued"])

    return documents.select(key, "text").mapInArrow(find, f"{key} {kind}, start bigint, length bigint, shape string, features array<double>, issued int")


def train(labelled: DataFrame, sample: int | None = None) -> RandomForestClassificationModel | float:
    """The forest from labelled findings (features, label), of which all are used. With `sample`, about so many, up to half
    of it from either label, with weights that give each label its true size. If all findings have one label, its share of 1."""
    known = labelled.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    if sample is None:
        picked = known.withColumn("weight", F.lit(1.0))
        sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    else:
        key = F.concat_ws(":", *[F.col(c).cast("string") for c in labelled.columns if c not in ("features", "label")])
        picked, sizes = stratified_sample(known.withColumn("_key", key), "_key", "label", sample, "findings")
    if len(sizes) < 2:
        return 1.0 if sizes.get(1.0) else 0.0
    if sample is not None:
        picked = stored(picked.select("features", "label", "weight"))
        if picked.select("label").distinct().count() < len(sizes):
            raise ValueError(f"the sample of findings misses a label; findings by label: {sizes}")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(picked.select(array_to_vector("features").alias("x"), "label", "weight"))


def probability(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """`found` with `score`, the forest's probability that the finding is a secret, instead of `features`."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model)).drop("features")
    scored = model.transform(found.withColumn("x", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*[c for c in found.columns if c != "features"], "score")


def fitted(documents: DataFrame, held: Column | None = None) -> tuple[frozenset[str], RandomForestClassificationModel | float]:
    """Dictionary and forest, with labels by `looks_issued`, from all candidates of documents that satisfy `held`.

    The candidates are found once and written; the forest reads them as often as it needs.
    """
    dictionary = dictionary_of(documents)
    source = documents if held is None else documents.filter(held)
    found = stored(find_candidates(source, dictionary).select("features", F.col("issued").alias("label")))
    return dictionary, train(found)


def scan(documents: DataFrame, dictionary: frozenset[str], model: RandomForestClassificationModel | float, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, shape, score, is_secret of every candidate; the value itself is not handed on.

    Texts are read whole; null and empty ones have no candidates. Repeated rows are scanned again, ids may be null.
    Only doc_id and text are read; an empty table gives an empty result.
    """
    scored = probability(find_candidates(documents, dictionary).drop("issued"), model)
    return scored.withColumn("is_secret", F.col("score") >= threshold)


def mask_secrets(documents: DataFrame, dictionary: frozenset[str], model: RandomForestClassificationModel | float, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of `documents`, each secret in the text replaced by MASK, and `n_chars` corrected if it is there.

    Only texts with a candidate are touched: they are written to the shared folder with a row number, scored, and joined with
    the spans found in them, so rows with equal or null ids keep apart.
    """
    kinds, columns = dict(documents.dtypes), documents.columns
    has = F.coalesce(F.col("text").rlike(HAS_CANDIDATE), F.lit(False))
    touched = stored(documents.filter(has).select(F.struct(*[documents[c] for c in columns]).alias("_row"), F.monotonically_increasing_id().alias("_number")))
    found = find_candidates(touched.select("_number", F.col("_row.text").alias("text")), dictionary, "_number").drop("issued")
    secrets = probability(found, model).filter(F.col("score") >= threshold)
    spans = secrets.groupBy("_number").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_spans"))
    source = F.col("_row.text")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    cut = lambda a, b: F.substring(source, (a + 1).cast("int"), (b - a).cast("int"))
    masked = F.aggregate("_spans", start, lambda s, x: F.struct(F.concat(s["done"], cut(s["at"], x["start"]), F.lit(MASK)).alias("done"), (x["start"] + x["length"]).alias("at")),
                         lambda s: F.concat(s["done"], cut(s["at"], F.length(source).cast("bigint"))))
    text = F.when(F.col("_spans").isNull(), source).otherwise(masked)
    joined = touched.join(spans, "_number", "left").withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_spans").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text"))}
    clean = joined.select(*[changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in columns])
    return documents.filter(~has).unionAll(clean)
