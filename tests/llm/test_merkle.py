"""The manifest against a tree built in one piece."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sigseg.llm import shared
from sigseg.llm.merkle import leaf, merkle_manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(level, fanout):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout):
    for level in levels[:-1]:
        run = i - i % fanout
        yield level[run:i], level[i + 1 : run + fanout]
        i //= fanout


def brute(rows, fanout, changed):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: grow([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fanout) for s in order}
    high = grow([grown[s][-1][0] for s in order], fanout)
    out = []
    for at, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            sides = [*path(grown[s], i, fanout), *path(high, at, fanout)]
            now = plain_leaf((*r[:4], r[4].replace("\n", ""))) if r[4] is not None and changed(r[0]) else h
            for a, b in sides:
                now = sha("".join([*a, now, *b]))
            proof = sha("".join("".join(a + b) for a, b in sides))
            out.append((r[0], h, grown[s][-1][0], high[-1][0], proof, now, now == high[-1][0]))
    return sorted(out, key=str)


def even(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


DDL = "doc_id long, source string, lang string, n_chars long, text string"


def rows():
    rng = random.Random(4)
    out = [(2**60 + i, rng.choice(["a", "b", "a", "a", None, "", "é", "=x", "-"]), rng.choice(["en", None]), i, rng.choice(["x\ny", "", None, "ab", "\n", "é\n漢"])) for i in range(400)]
    return [*out, *out[:5], (None, "a", None, None, None), (None, "a", None, None, "q\n"), (7, "lone", "en", 0, "z" * 1_500_000 + "\n")]


def changed():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def test_manifest_equals_one_tree(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in data], DDL + ", tree string, place int").repartition(5)
    for fanout, levels, limit in ((3, 4, 200_000), (3, 1, 0), (2, 2, 0)):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
        got = merkle_manifest(df, changed(), fanout, levels).collect()
        assert sorted(map(tuple, got), key=str) == brute(data, fanout, even)
        assert {r.verified for r in got} == {True, False}
    assert all(r.verified for r in merkle_manifest(df).collect())


def test_many_sources_and_few_rows(spark):
    data = [(i, f"s{i}", "en", 1, "a\n") for i in range(300)]
    assert sorted(map(tuple, merkle_manifest(spark.createDataFrame(data, DDL), changed()).collect()), key=str) == brute(data, 3, even)
    for n in (0, 1, 2):
        got = merkle_manifest(spark.createDataFrame(data[:n], DDL), changed()).collect()
        assert sorted(map(tuple, got), key=str) == (brute(data[:n], 3, even) if n else [])


def test_leaf_tells_null_from_text(spark):
    df = spark.createDataFrame([(1, None, "en", 2, "-"), (1, "-", "en", 2, "-")], DDL)
    assert len({r[0] for r in df.select(leaf()).collect()}) == 2
