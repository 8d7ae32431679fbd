import random
import re
from collections import defaultdict

import numpy as np

from sigseg.llm import line_dedup as LD
from sigseg.llm import shared
from sigseg.llm.line_dedup import CuckooFilter, LineIndex, line_dedup


def key(line):
    bare = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(docs, min_chars, min_docs):
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["ab", "Cd", "é", "漢"]) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    docs = [(i, "\n".join(rng.choice(["", " ", "\t\x0b"]) + rng.choice(pool) + rng.choice(["", "\r", " "]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    return docs + [(100, None), (101, ""), (102, "\n\n"), (None, pool[0]), (5, pool[1]), (103, (pool[2] + "\n") * 3)]


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n_lines string, drop int").repartition(3)
        assert rows(line_dedup(df, 10, 5)) == brute(docs, 10, 5)


def test_insertion_is_undone_by_deletion(spark, monkeypatch):
    docs = [d for d in corpus(3) if d[0] != 5 and d[0] is not None]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    table = lambda index: sorted(tuple(r) for r in index.counts.collect())
    first, later = docs[:40], docs[40:]
    index = LineIndex(spark, 10, 4, shard_keys=8).insert(make(first))
    before, filters = table(index), index.filters.collect()
    index.insert(make(later))
    assert table(index) == table(LineIndex(spark, 10, 4).insert(make(docs))) != before
    assert rows(index.apply(make(docs))) == brute(docs, 10, 4)
    monkeypatch.setattr(LD, "FILTER_KEYS", 0)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    assert rows(index.apply(make(docs))) == brute(docs, 10, 4)
    index.delete(make(later))
    assert table(index) == before
    assert rows(index.apply(make(first))) == brute(first, 10, 4)
    for r in filters:
        again = next(x for x in index.filters.collect() if x["shard"] == r["shard"])
        assert np.count_nonzero(np.frombuffer(again["filter"], np.uint16)) == np.count_nonzero(np.frombuffer(r["filter"], np.uint16))


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    made = CuckooFilter(len(keys))
    assert made.insert(keys[:15_000])
    assert made.contains(keys[:15_000]).all()
    assert made.contains(keys[15_000:]).mean() < 0.01
    made.delete(keys[:5000])
    assert made.contains(keys[5000:15_000]).all()
    assert np.count_nonzero(made.table) == 10_000
    twice = CuckooFilter(100)
    assert twice.insert(np.repeat(keys[:3], 2))
    twice.delete(np.repeat(keys[:3], 2))
    assert not twice.table.any()
    small = CuckooFilter(10)
    assert not small.insert(keys[:5000])
