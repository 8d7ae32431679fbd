import hashlib
import math
from collections import Counter, defaultdict

import pytest

from sigseg.llm import queries as Q
from sigseg.llm.mixing import mix_sources, solve
from sigseg.llm.mixing import tokens_of as mix_tokens

SCHEMA = "doc_id long, text string, source string, copy string"


def tokens_of(text):
    return -(-2 * len((text or "").encode()) // 5)


def brute(docs, limit, block_tokens):
    """(doc_id, source, copy, block) of the mix that repeats no source more than ``limit`` times."""
    size = {i: tokens_of(t) for i, t, _ in docs}
    tokens = Counter()
    for i, _, s in docs:
        tokens[s] += size[i]
    low, high = 0.0, 1.0
    spread = max(tokens.values()) / min(tokens.values())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if spread ** (1 - mid) <= limit else (mid, high)
    a = math.ceil(high * 1e6) / 1e6
    powers = {s: t**a for s, t in tokens.items()}
    budget = max(sum(powers.values()) * t / powers[s] for s, t in tokens.items())
    n_blocks = max(1, math.ceil(budget / block_tokens))
    out = []
    for s, t in tokens.items():
        grant, upto = round(powers[s] / sum(powers.values()) * budget), 0
        order = sorted((hashlib.md5(f"1|{i}".encode()).hexdigest(), i) for i, _, x in docs if x == s)
        for copy in range(3):
            for _, i in order:
                upto += size[i]
                if upto <= grant:
                    out.append((i, s, copy, min(n_blocks - 1, math.floor((upto - size[i]) / grant * n_blocks))))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.op4_mix_sources(spark, sf).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(docs, 2.0, 1 << 22)
    assert len({(r.block, r.place) for r in got}) == len(got)


def test_blocks_hold_the_weights(spark):
    docs = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}", "x") for i in range(3000)]
    got = mix_sources(spark.createDataFrame(docs, SCHEMA).repartition(4), max_repeats=2.0, block_tokens=2000).collect()
    assert sorted(((r.doc_id, r.source, r.copy, r.block) for r in got), key=str) == brute([d[:3] for d in docs], 2.0, 2000)
    assert {r.doc_id for r in got} == {d[0] for d in docs}
    per = defaultdict(Counter)
    for r in got:
        per[r.block][r.source] += tokens_of(r.text)
    whole = sum(per.values(), Counter())
    for counts in per.values():
        for s, n in whole.items():
            assert abs(counts[s] / sum(counts.values()) - n / sum(whole.values())) < 0.02


def test_entropy_target(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1)], "s string, tokens long")
    found = solve(sources, 0.9, None)
    assert found.entropy == pytest.approx(0.9, abs=1e-5)
    assert solve(sources, None, 1.0).exponent == 1.0
    with pytest.raises(ValueError, match="either"):
        solve(sources, None, None)


def test_unspaced_text_weighs_by_its_bytes(spark):
    rows = [(i, "漢字仮名" * 50, "zh", "") for i in range(4)] + [(10 + i, "word " * 120, "en", "") for i in range(4)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), max_repeats=1.0).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 10, 11, 12, 13]
    odd = spark.createDataFrame([(None,), ("",), (" ",), ("漢字",), ("12345",), ("123456",)], "t string")
    assert [r[0] for r in odd.select(mix_tokens(odd.t)).collect()] == [tokens_of(r.t) for r in odd.collect()] == [0, 0, 1, 3, 2, 3]


def test_edges(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, ""), (2, "", "a", ""), (None, "x y", None, ""), (3, "x", "a", ""), (3, "x", "a", "")]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA))
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 2, None, 3, 3])
    assert mix_sources(spark.createDataFrame([(1, "", "a", ""), (2, None, "b", "")], SCHEMA)).count() == 2
