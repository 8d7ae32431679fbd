import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex

from sigseg.llm import language_id as L
from sigseg.llm import queries as Q
from sigseg.llm.language_id import identify, learn, viterbi


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 7, 12)
    off = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (off[-1], 3))
    label = viterbi(L.Scores.of(scores), off, 2.0)
    for a, b in itertools.pairwise(off):
        value = lambda path, a=a: sum(scores[a + i, x] for i, x in enumerate(path)) - 2.0 * sum(x != y for x, y in itertools.pairwise(path))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(label[a:b].tolist()) == pytest.approx(best)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op2_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs)
    parts = {r.lang: " ".join(r.text.split()[:60]) for r in docs.filter("n_chars > 2000" if "n_chars" in docs.columns else "length(text) > 2000").collect()}
    text = parts["en"] + " " + parts["de"] + " 漢字 " + parts["fr"]
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "12 !!", "x"), (5, parts["es"], None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()}
    spans = got[1].spans
    assert [s.lang for s in spans if s.end - s.start > 50] == ["en", "de", "fr"]
    assert abs(spans[0].end - len(parts["en"])) < 30
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und", "und", "und", "es"]
    assert got[4].score == 0
    assert got[5].score > 0.9


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn(empty)
    assert identify(empty, model).count() == 0
    assert identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def plain_prediction(text, counts, letters_of, languages):
    """Language and score of a text by the definitions: scripts, hashed pairs and triples, and a walk over all words."""
    script_of = lambda c: next((n for n, a, b in L.SCRIPTS if a <= ord(c) <= b), "Latin")
    words, last = [], None
    for at, c in enumerate(text or ""):
        if regex.match(r"\p{L}", c):
            kind = script_of(c)
            if last == (at - 1, kind):
                words[-1][1].append(c)
            else:
                words.append((kind, [c]))
            last = (at, kind)
    if not words:
        return "und", 0.0
    scores = []
    for kind, word in words:
        uses = [letters_of[x][kind] >= L.SCRIPT_SHARE * max(sum(letters_of[x].values()), 1) for x in languages]
        row = []
        for i, x in enumerate(languages):
            total = 0.0 if uses[i] or not any(uses) else -1e4
            for kind_of, bucket in grams_of(word):
                n = counts[x][kind_of]
                total += math.log((n[bucket] + L.SMOOTHING) / (sum(n.values()) + L.SMOOTHING * L.BUCKETS)) / 2
            row.append(total)
        scores.append(row)
    value, back = scores[0], []
    for row in scores[1:]:
        best = max(range(len(languages)), key=lambda j: value[j])
        stay = [v >= value[best] - L.SWITCH_PENALTY for v in value]
        back.append([j if stay[j] else best for j in range(len(languages))])
        value = [(v if s else value[best] - L.SWITCH_PENALTY) + x for v, s, x in zip(value, stay, row, strict=True)]
    state = max(range(len(languages)), key=lambda j: value[j])
    path = [state]
    for step in reversed(back):
        path.append(step[path[-1]])
    letters = Counter()
    for j, (_, word) in zip(reversed(path), words, strict=True):
        letters[j] += len(word)
    best = min(letters, key=lambda j: (-letters[j], j))
    return languages[best], letters[best] / sum(letters.values())


def grams_of(word):
    """("pair" or "triple", bucket) of each letter of a word."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    for i, c in enumerate(low):
        before, after = low[i - 1] if i else 0, low[i + 1] if i + 1 < len(low) else 0
        pair = mix(before << 21 | c)
        yield "pair", pair % L.BUCKETS
        yield "triple", mix(pair ^ (after + 1) * 0x9E3779B97F4A7C15 % 2**64) % L.BUCKETS


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def test_query_equals_plain_prediction(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(lambda: {"pair": Counter(), "triple": Counter()})
    letters_of = defaultdict(Counter)
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            for word in regex.findall(r"\p{L}+", r.text or ""):
                for part in regex.findall("|".join([*(f"[{chr(a)}-{chr(b)}]+" for _, a, b in L.SCRIPTS if b < 0x500), ".+?(?=[Ͱ-ԯ]|$)"]), word):
                    kind = next((n for n, a, b in L.SCRIPTS if a <= ord(part[0]) <= b), "Latin")
                    letters_of[r.lang][kind] += len(part)
                    for kind_of, bucket in grams_of(part):
                        counts[r.lang][kind_of][bucket] += 1
    languages = sorted(counts)
    got = {r.doc_id: r for r in Q.op2_language_id(spark, sf).collect()}
    short = [r for r in docs if len(r.text or "") < 4000]
    assert len(short) > 100
    for r in short:
        name, score = plain_prediction(r.text, counts, letters_of, languages)
        assert got[r.doc_id].lang_pred == name, r.text[:80]
        assert abs(got[r.doc_id].score - score) < 1e-6
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def invented(rng, k):
    """A sentence of a language with letters of its own habits."""
    letters = [chr(97 + (7 * k + i * (1 + k % 5)) % 26) for i in range(6)] + [chr(0xE0 + k % 20), chr(0x101 + 2 * (k // 20))]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40))


def test_three_hundred_languages(spark, monkeypatch):
    rng = random.Random(4)
    taught = [(invented(rng, k), f"l{k:03d}") for k in range(300) for _ in range(6)]
    model = learn(spark.createDataFrame(taught, "text string, lang string").repartition(4))
    assert len(model.languages) == 300 and model.log_probability.shape[1] == 300
    asked = [(k, invented(rng, k)) for k in range(300)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert np.mean([got[k] == f"l{k:03d}" for k in got]) > 0.9
    counts, letters_of = defaultdict(lambda: {"pair": Counter(), "triple": Counter()}), defaultdict(Counter)
    for text, name in taught:
        for word in regex.findall(r"\p{L}+", text):
            letters_of[name]["Latin"] += len(word)
            for kind, bucket in grams_of(word):
                counts[name][kind][bucket] += 1
    for k, text in asked[:3]:
        assert plain_prediction(text, counts, letters_of, model.languages)[0] == got[k]
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    monkeypatch.setattr(L, "HELD_LANGUAGES", 1)
    few = learn(spark.createDataFrame([("aaa bbb", "x"), ("ccc ddd eee", "y"), ("f", "z")], "text string, lang string"))
    assert few.languages == ["x", "y"] and few.uses[0].all()


def test_memory_does_not_grow_with_letters_times_languages(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(160_000))[: 1 << 20]
    model = L.LanguageModel([f"l{i:03d}" for i in range(300)], np.random.default_rng(1).normal(-4, 1, (2 * L.BUCKETS, 300)).astype(np.float32), np.ones((L.N_SCRIPTS, 300), bool))
    tracemalloc.start()
    L._judge(pa.array([text]), model, L.SWITCH_PENALTY)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6, peak
