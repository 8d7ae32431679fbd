"""Toxicity of documents, learned from document labels as multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the
weights of its features (words, beginnings of words, pairs of words; pairs of
letters where words are long, as in unspaced scripts); the document's score is
their noisy-or, 1 - product of (1 - score). So one toxic sentence makes a toxic
document, and the weights that explain the documents' labels say which sentence
it is.

Learning takes labelled documents, TRAIN_ROWS at most, drawn by a hash; of a
doc_id that repeats, the smallest text and the largest label. Features are counted
by label in all of these, and those that speak for the label by a likelihood
ratio (G2, MAX_FEATURES at most) are kept. The documents then shrink to the
kept features of their sentences, and one task fits weights and bias to the
noisy-or likelihood by gradient steps.

Sentences end at ``. ! ? \\n`` and their wide forms, and after SENTENCE_WORDS
words. Null, empty and letterless texts have no sentence and score 0. Labels
that are null, or of unknown doc_ids, teach nothing; if no label is 1, or none
0, all scores are 0. Repeated rows are scored each for itself, texts in slices
of 1 MiB, longer ones alone and whole. An empty table gives no rows. Extra
columns are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.llm import textops as T
from sigseg.llm.shared import Scratch

#: Labelled documents to learn from, at most; beyond, a hash of the doc_id draws about nine tenths of them.
TRAIN_ROWS = 32_768
#: Hashed features; features that are kept at most, and the G2 from which one is.
BUCKETS, MAX_FEATURES, LEAST_G2 = 1 << 20, 4_096, 12.0
#: Bytes of the beginnings of words; words of more bytes than LONG_WORD also have pairs of letters.
PREFIXES, LONG_WORD = (4, 5, 6, 7, 8), 24
SENTENCE_WORDS = 64
#: Of the fit: steps, size of the first, weight decay, first bias.
STEPS, RATE, DECAY, BIAS = 150, 0.2, 3e-5, -5.0
#: Score from which a sentence counts as offending.
OFFENDING = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True
#: Wide full stop, exclamation and question mark.
_WIDE = [(0xE3, 0x80, 0x82), (0xEF, 0xBC, 0x81), (0xEF, 0xBC, 0x9F)]


@dataclass(frozen=True)
class Sentences:
    """Features of a batch of texts, each once a sentence, and where the sentences lie."""

    feature: np.ndarray
    sentence: np.ndarray  # of each feature
    text: np.ndarray  # of each sentence
    start: np.ndarray  # in bytes of the batch
    end: np.ndarray


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters of Latin-1."""
    low = T.LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[second] += 0x20
    return low


def sentences(column: pa.Array, kept: np.ndarray | None = None) -> Sentences:
    """All features of the texts, or those that ``kept`` (a flag for each bucket) holds."""
    raw, off = T.flat(column)
    data = _folded(raw)
    stop, letter = _STOP[data], _LETTER[data]
    for a, b, c in _WIDE:
        at = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
        stop[at] = True
        letter[at] = letter[at + 1] = letter[at + 2] = False
    start, end = T.runs(letter, off)
    text = np.searchsorted(off, start, "right") - 1
    stops = np.cumsum(stop)[start]
    new = np.ones(len(start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(len(start)) - first[np.cumsum(new) - 1]) % SENTENCE_WORDS == 0 if len(first) else False
    sentence = np.cumsum(new) - 1
    length = end - start

    buckets: list[np.ndarray] = []
    owners: list[np.ndarray] = []

    def add(hashes: np.ndarray, own: np.ndarray) -> None:
        found = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        if kept is not None:
            some = kept[found]
            found, own = found[some], own[some]
        buckets.append(found)
        owners.append(own)

    word = T.span_hashes(data, start, end)
    add(word, sentence)
    for n in PREFIXES:
        more = np.flatnonzero(length > n)
        add(T.mix(T.span_hashes(data, start[more], start[more] + n) + np.uint64(n)), sentence[more])
    pair = np.flatnonzero(~new[1:])
    add(T.mix(word[pair] * np.uint64(3) + word[pair + 1]), sentence[pair])
    long = np.flatnonzero(length > LONG_WORD)
    if len(long):
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, start[long], 1)
        np.add.at(inside, end[long], -1)
        at = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & T.is_char_start(data))
        own = np.searchsorted(start, at, "right") - 1
        two = np.flatnonzero(own[2:] == own[:-2]) if len(at) > 2 else np.zeros(0, np.int64)
        add(T.mix(T.span_hashes(data, at[two], at[two + 2]) + np.uint64(2)), sentence[own[two]])
    key = np.unique(np.concatenate(owners) * BUCKETS + np.concatenate(buckets))
    last = np.append(np.flatnonzero(new)[1:], len(start)) - 1 if len(start) else np.zeros(0, np.int64)
    return Sentences(key % BUCKETS, key // BUCKETS, text[new], start[new], end[last])


@dataclass(frozen=True)
class ToxicityModel:
    weight: np.ndarray  # of each bucket
    bias: float


def _draw(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, label of the documents to learn from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    one = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    n, scale = one.count(), 1 << 30
    if n > rows:
        one = one.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(scale)) < int(0.9 * rows / n * scale))
    drawn = one.limit(rows)  # the draw is a tenth below the limit, which cuts nothing unless the hash fails
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a feature."""
    for part in T.slices(batches, "text"):
        x = sentences(part.column(1))
        label = part.column(2).to_numpy()
        key = np.unique(x.text[x.sentence] * BUCKETS + x.feature)
        found, which = np.unique(key % BUCKETS, return_inverse=True)
        toxic = label[key // BUCKETS] == 1
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.bincount(which, toxic, len(found)).astype(np.int64)), pa.array(np.bincount(which, ~toxic, len(found)).astype(np.int64))], names=["bucket", "n1", "n0"])


def _g2(n1: int, n0: int) -> F.Column:
    """Likelihood ratio of a feature that is met in ``n1`` toxic and ``n0`` other documents; negative if it speaks against."""
    a, b, n = F.col("n1").cast("double"), F.col("n0").cast("double"), float(n1 + n0)
    part = lambda seen, of, whole: F.when(seen > 0, seen * F.log(seen * F.lit(n) / (of * F.lit(float(whole))))).otherwise(0.0)
    have, lack = a + b, F.lit(n) - a - b
    total = 2 * (part(a, have, n1) + part(b, have, n0) + part(n1 - a, lack, n1) + part(n0 - b, lack, n0))
    return F.when(a * n > have * n1, total).otherwise(-total)


def _fit(feature: np.ndarray, sentence: np.ndarray, of: np.ndarray, plain: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features 0.. and the bias, by Adam with a falling rate.

    ``of`` is the document of each sentence that has features, ``plain`` the number of a document's other sentences.
    """
    n, k, n_docs = len(of), int(feature.max(initial=-1)) + 1, len(label)
    x = np.append(np.zeros(k), BIAS)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(sentence, x[feature], n) + x[-1]
        q = np.bincount(of, np.logaddexp(0, z), n_docs) + plain * np.logaddexp(0, x[-1])  # -log of the chance that no sentence is toxic
        slope = np.where(label == 1, -1 / np.expm1(np.clip(q, 1e-9, 50)), 1.0) / n_docs
        by_sentence = slope[of] / (1 + np.exp(-z))
        g = np.append(np.bincount(feature, by_sentence[sentence], k) + DECAY * x[:-1], by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-x[-1])))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * min(1.0, 2 - 2 * t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x[:-1], float(x[-1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) marks."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    drawn = scratch.write(_draw(docs, labels, rows), "drawn")
    size = {r.label: r.n for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nothing = ToxicityModel(np.zeros(BUCKETS, np.float32), -np.inf)
    if len(size) < 2:
        return nothing
    counts = drawn.mapInArrow(_counts, "bucket int, n1 bigint, n0 bigint").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    best = counts.withColumn("g2", _g2(size[1], size[0])).filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "bucket").limit(MAX_FEATURES)
    chosen = np.sort(best.select("bucket").toArrow()["bucket"].to_numpy())
    flags = np.zeros(BUCKETS, bool)
    flags[chosen] = True
    shared = spark.sparkContext.broadcast(flags)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            x = sentences(part.column(1), shared.value)
            some, which = np.unique(x.sentence, return_inverse=True)  # sentences with features
            plain = np.bincount(x.text, minlength=part.num_rows) - np.bincount(x.text[some], minlength=part.num_rows)
            inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(which, minlength=len(some)))), pa.int32()), pa.array(x.feature.astype(np.int32)))
            outer = pa.ListArray.from_arrays(pa.array(np.searchsorted(x.text[some], np.arange(part.num_rows + 1)), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(plain.astype(np.int64)), outer], names=["doc_id", "label", "plain", "bags"])

    small = scratch.write(drawn.mapInArrow(shrink, "doc_id bigint, label int, plain bigint, bags array<array<int>>"), "bags")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("doc_id").combine_chunks()  # the same sums whatever the order of arrival
        if not table.num_rows:
            return
        bags = table["bags"].combine_chunks()
        of = T.owner(bags.offsets.to_numpy() - bags.offsets[0].as_py())
        inner = bags.flatten()
        own = T.owner(inner.offsets.to_numpy() - inner.offsets[0].as_py())
        feature = np.searchsorted(chosen, inner.flatten().to_numpy())
        weight, bias = _fit(feature, own, of, table["plain"].to_numpy(), table["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(chosen[: len(weight)], -1).astype(np.int32)), pa.array(np.append(weight, bias))], names=["bucket", "weight"])

    found = small.repartition(1).mapInArrow(solve, "bucket int, weight double").toArrow()
    bucket, weight = found["bucket"].to_numpy(), found["weight"].to_numpy()
    if not len(bucket):
        return nothing
    table = np.zeros(BUCKETS, np.float32)
    table[bucket[bucket >= 0]] = weight[bucket >= 0]
    return ToxicityModel(table, float(weight[bucket < 0][0]))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _judge(column: pa.Array, model: ToxicityModel, kept: np.ndarray) -> list[pa.Array]:
    n = len(column)
    if np.isneginf(model.bias):
        return [pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int32)), pa.array([[]] * n, _SPANS)]
    x = sentences(column, kept)
    z = np.bincount(x.sentence, model.weight[x.feature], len(x.text)) + model.bias
    score = -np.expm1(-np.bincount(x.text, np.logaddexp(0, z), n))
    own = 1 / (1 + np.exp(-z))
    off = np.searchsorted(x.text, np.arange(n + 1))
    bad = own >= OFFENDING
    some = np.diff(off) > 0
    if some.any():
        top = np.zeros(n)
        top[some] = np.maximum.reduceat(z, off[:-1][some])
        bad |= (score >= 0.5)[x.text] & (z == top[x.text])  # the likeliest sentence of a toxic document in any case
    data, byte_off = T.flat(column)
    points = np.append(0, np.cumsum(T.is_char_start(data)))
    base = points[byte_off[x.text[bad]]]
    spans = pa.StructArray.from_arrays([pa.array(points[x.start[bad]] - base, pa.int32()), pa.array(points[x.end[bad]] - base, pa.int32()), pa.array(own[bad])], names=["start", "end", "score"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(x.text[bad], np.arange(n + 1)), pa.int32()), spans)
    return [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), lists]


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 from 0.5 on) and ``sentences``, the offending ones (start and end in code points of the text, and score)."""
    added = ["score", "predicted", "sentences"]
    rest = docs.select(*[c for c in docs.columns if c not in added])
    at = rest.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model, model.weight != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, *_judge(part.column(at), *shared.value)], names=[*part.schema.names, *added])

    return rest.mapInArrow(run, T.with_fields(rest, "score double, predicted int, sentences array<struct<start:int,end:int,score:double>>"))
