import numpy as np

from sigseg.llm.topk_search import SortedLists, quantize, topk_search, usable


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-9, 9, 8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [1, 2]), (2001, [3, 4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, vector array<bigint>, score string").repartition(3)
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk_search(df, df.filter("vec_id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, queries, 5)


def test_stops_early_and_keeps_ties():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-50, 50, (5000, 3))
    lists = SortedLists(np.arange(5000), vectors)
    for q in range(20):
        expected = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:5]
        assert [(-s, i) for i, s in lists.top(q, vectors[q].astype(float), 5, -np.inf)] == expected
    assert lists.scored < 20 * 2500


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.1, -0.1]), (None, [1.0, 1.0]), (5, [0.1, -0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(usable("embedding")).select("vec_id", quantize("embedding").alias("vector"))
    assert sorted(tuple(r) for r in topk_search(df, df.filter("vec_id = 0")).collect()) == [(0, 1, 5, -128), (0, 2, 5, -128)]
    assert topk_search(df.limit(0), df.limit(0)).count() == 0
