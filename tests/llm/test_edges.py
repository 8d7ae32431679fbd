"""Texts beyond a slice, words that fool weak hashes, empty tables, clashing columns and joins that shuffle, for every operator on texts."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sigseg.llm import queries as Q
from sigseg.llm import shared
from sigseg.llm import textops as T
from sigseg.llm.bpe_automaton import bpe_decode, bpe_encode
from sigseg.llm.chat_format import chat_calls, link_tool_calls
from sigseg.llm.language_id import identify, learn
from sigseg.llm.line_dedup import line_dedup
from sigseg.llm.mixing import mix_sources
from sigseg.llm.near_dup import near_duplicates
from sigseg.llm.quality_rules import repetition_coverage
from sigseg.llm.substring_dedup import substring_dedup
from sigseg.llm.topk_search import topk_search
from sigseg.llm.token_files import read_token_files, write_token_files
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_near
from tests.llm.test_quality_rules import brute as brute_quality
from tests.llm.test_substring_dedup import brute as brute_substrings
from tests.llm.test_textops import thue_morse

DDL = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    one, two = thue_morse(1024)
    long = "\n".join(" ".join(rng.choice(["ab", "Cd", "é", "xyz"]) + str(rng.randrange(9000)) for _ in range(12)) for _ in range(14000))
    assert len(long.encode()) > T.SLICE_BYTES
    short = "".join(f"w{i} " for i in range(40))
    rows = [(i, f"{short}\n{one if i % 2 else two}\n{short}") for i in range(12)]
    return [*rows, (20, one), (21, two), (22, one), (30, long), (31, long[: len(long) * 9 // 10]), (32, short), (40, None), (41, ""), (41, "")]


def table(spark, docs):
    return spark.createDataFrame([(*d, 1, "x", "y") for d in docs], DDL + ", n_chunks int, source string, ids string").repartition(3)


def test_bpe_and_token_files(spark, docs, tmp_path):
    spec, library = Q.tokenizer_spec(), Tokenizer.from_str(Q.tokenizer_spec())
    expected = sorted((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in docs)
    got = bpe_encode(table(spark, docs), spec, packed=True, decoded="decoded").collect()
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in got) == expected
    write_token_files(table(spark, docs), spec, f"file://{tmp_path}/a")
    assert sorted((r.doc_id, bytes(r.ids)[:-4]) for r in read_token_files(spark, f"file://{tmp_path}/a").collect()) == [e[:2] for e in expected]
    none = table(spark, docs).limit(0)
    assert bpe_decode(bpe_encode(none, spec), spec).count() == bpe_encode(none, spec, packed=True, decoded="d").count() == 0
    assert corpus_pipeline.tokenize(spark, none.selectExpr("doc_id", "text", "'' lang", "source", "0L n_chars"), "").count() == 0


def test_lines(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    got = line_dedup(table(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == brute_lines(docs, 40, 5)
    assert sum(r.n_dropped for r in got) >= 10


def test_substrings(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    spaced = [d for d in docs if d[0] not in (*range(12), 20, 21, 22)]  # the plain version has no cuts inside long words
    got = substring_dedup(table(spark, spaced)).collect()
    assert sorted((r.doc_id, r.n_chunks, r.shared_chunks, r.removed_chunks, r.removed_chars, r.first_docs, r.text or "") for r in got) == brute_substrings(spaced)


def test_near_duplicates(spark, docs):
    assert {tuple(r) for r in near_duplicates(table(spark, docs), 4).collect()} == brute_near(docs, 4, 80)


def test_quality(spark, docs):
    some = [d for d in docs if d[0] not in (30, 31)]
    doubled = [*some, (50, docs[15][1] + "\n" + docs[15][1])]
    got = {r.doc_id: r for r in repetition_coverage(table(spark, doubled)).collect()}
    for i, text in some:
        n, chars, symbols, again, repeat, coverage, share, failed, junk, kept, _ = brute_quality(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.too_many_symbols, r.kept) == (n, chars, symbols, again, repeat, failed, junk, kept)
    assert got[50].n_words == 2 * len(docs[15][1].split()) == got[50].n_repeat_words and got[50].n_dup_lines == 14000 and got[50].base_failed


def test_language(spark, docs):
    taught = spark.createDataFrame([("eins zwei drei vier und noch mehr", "de"), ("one two three four and so on", "en"), (None, "en"), ("x", None)], "text string, lang string")
    rows = [*docs, (60, "eins und zwei " * 120_000), (61, "12 34 !")]
    got = {r.doc_id: r for r in identify(table(spark, rows), learn(taught)).collect()}
    assert got[60].lang_pred == "de" and got[60].score == 1.0 and len(got[60].spans) == 1
    assert [got[i].lang_pred for i in (40, 41, 61)] == ["und"] * 3
    many = spark.createDataFrame([(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)} text", f"l{i}") for i in range(300)], "text string, lang string")
    model = learn(many)
    assert len(model.languages) == 300 and model.log_probability.shape[1] == 300


def test_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    rows = [*docs, (None, "a b"), (None, "a b"), (None, None)]
    got = mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(hashlib.md5((r.text or "").encode()).hexdigest() for r in got) == sorted(hashlib.md5((t or "").encode()).hexdigest() for _, t in rows)


def test_chat(spark):
    long = "é\n" * (1 << 20)
    huge = "x" * (160 << 20)
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (None, 0, "user", ""), (3, 0, "user", huge), (3, 1, "assistant", "c")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id long, turn long, role string, text string, status string, depth int, n boolean").repartition(2)
    out = link_tool_calls(*chat_calls(df), Q.CHAT_SCHEMA)
    assert out.columns == ["conv_id", "call_id", "turn", "depth", "status", "valid", "errors", "json"]
    got = out.selectExpr("coalesce(conv_id, -1) c", "status", "valid", "errors", "if(c = 3, length(json) < 1000, json is not null) j", "if(c = 1, json, null) text").collect()
    assert sorted((r.c, r.status, r.valid) for r in got) == [(-1, "no_result", True), (1, "linked", True), (2, "duplicate", False), (2, "duplicate", True), (2, "linked", True), (3, "linked", False)]
    assert all(r.j for r in got) and [r.errors for r in got if r.c == 3] == [["arguments are not JSON"]]
    one = json.loads(next(r.text for r in got if r.c == 1))
    assert one["content"] == one["arguments"]["prompt"] == long
    assert link_tool_calls(*chat_calls(df.limit(0)), Q.CHAT_SCHEMA).count() == 0


def test_topk(spark):
    rows = [(i, [i % 7, -i, 3], "x", 1) for i in range(60)] + [(5, [9, 9, 9], "x", 1), (5, [9, 9, 9], "x", 1), (None, [1, 1, 1], "y", 1), (70, None, "y", 1), (71, [], "y", 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, query_id string, score int")
    got = topk_search(df, df.filter("vec_id = 50"), k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(50, 1, 59, 2962), (50, 2, 58, 2911), (50, 3, 57, 2860)]
    assert topk_search(df.limit(0), df, k=3).count() == topk_search(df, df.limit(0), k=3).count() == 0
