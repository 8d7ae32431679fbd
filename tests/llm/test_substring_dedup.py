import random

import numpy as np

from sigseg.llm.substring_dedup import _GEAR, CUT_SHARE, MIN_WORDS, WINDOW, gear, substring_dedup


def word_spans(raw):
    spans, start = [], None
    for i, b in enumerate([*raw, 32]):
        if b in b" \t\n\v\f\r":
            if start is not None:
                spans.append((start, i))
            start = None
        elif start is None:
            start = i
    return spans


def brute_chunks(text):
    """Chunks as lists of word spans, from the definition of the hash."""
    raw, out = (text or "").encode(), []
    for k, (a, b) in enumerate(word_spans(raw)):
        cut = a >= WINDOW and sum(int(_GEAR[raw[a - 1 - j]]) << j for j in range(WINDOW)) % 65536 < int(CUT_SHARE * 65536)
        if k == 0 or cut:
            out.append([])
        out[-1].append((a, b))
    return raw, out


def brute(docs):
    split = [brute_chunks(text) for _, text in docs]
    pieces = [[raw[p[0][0] : p[-1][1]] for p in parts] for raw, parts in split]
    inside = [[i is not None] * len(p) for (i, _), p in zip(docs, pieces, strict=True)]
    while True:
        holders = {}
        for (i, _), p, flags in zip(docs, pieces, inside, strict=True):
            for x, f in zip(p, flags, strict=True):
                if f:
                    holders.setdefault(x, set()).add(i)
        new = []
        for (_, parts), p, flags in zip(split, pieces, inside, strict=True):
            known, found, k = [f and len(holders[x]) > 1 for x, f in zip(p, flags, strict=True)], [False] * len(p), 0
            while k < len(p):
                to = k
                while to < len(p) and known[to]:
                    to += 1
                if sum(map(len, parts[k:to])) >= MIN_WORDS:
                    found[k:to] = [True] * (to - k)
                k = max(to, k + 1)
            new.append(found)
        if new == inside:
            break
        inside = new
    out = []
    for (i, _), (raw, parts), p, repeated in zip(docs, split, pieces, inside, strict=True):
        gone = [r and min(holders[x]) < i for r, x in zip(repeated, p, strict=True)]
        kept, removed = raw[: parts[0][0][0]] if parts else raw, 0
        for k, part in enumerate(parts):
            piece = raw[part[0][0] : parts[k + 1][0][0] if k + 1 < len(parts) else len(raw)]
            kept, removed = (kept, removed + len(piece.decode())) if gone[k] else (kept + piece, removed)
        firsts = sorted({min(holders[x]) for x, g in zip(p, gone, strict=True) if g})
        out.append((-1 if i is None else i, len(parts), sum(repeated), sum(gone), removed, firsts, kept.decode()))
    return sorted(out)


def test_a_phrase_elsewhere_breaks_no_passage(spark):
    """Two documents share 60 words, ten of which a smaller one holds as well: the passage stays whole in one, and goes from the other."""
    rng = random.Random(2)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    docs, cases = [], 300
    middles, phrases = [], []
    for k in range(cases):
        passage, at = words(60), rng.randrange(5, 45)
        docs.append((10 * k + 1, " ".join(words(20) + passage[at : at + 10] + words(20))))
        docs += [(10 * k + i, " ".join(words(15) + passage + words(15))) for i in (5, 6)]
        middles.append(" ".join(passage[5:55]))
        phrases.append(docs[-3])
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, middle in enumerate(middles):
        assert middle in got[10 * k + 5].text and middle not in got[10 * k + 6].text
        assert got[10 * k + 1].text == phrases[k][1] and got[10 * k + 1].shared_chunks == 0
        assert got[10 * k + 6].first_docs == [10 * k + 5]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["ab", "é", "cdef", "x"]) + str(rng.randrange(400)) for _ in range(n))
    passages = [words(60) for _ in range(4)]
    docs = [(i, words(rng.randrange(0, 80)) + rng.choice([" ", "\n"]) + (rng.choice(passages) + "\n" if i % 2 else "") + words(rng.randrange(0, 80))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "  "), (None, passages[0]), (5, passages[1]), (200, docs[9][1]), (201, "漢字 " * 50), (202, "漢字 " * 50)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_chunks int, shared int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_chunks, r.shared_chunks, r.removed_chunks, r.removed_chars, r.first_docs, r.text or "") for r in substring_dedup(df).collect())
    assert got == brute(docs)
    caught = {g[0] for g in got if g[2]}
    assert {i for i in range(60) if i % 2} <= caught
    assert not {i for i in range(60) if i % 2 == 0} & caught


def test_insertion_keeps_later_chunks():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 4000).astype(np.uint8)
    b = np.insert(a, 1000, [1, 2, 3])
    assert (gear(a)[1000 + WINDOW :] == gear(b)[1003 + WINDOW :]).all()
    assert len(gear(a[:0])) == 0


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def unspaced(rng, kind, n):
    """About n words' worth of text without white space."""
    if kind == "cjk":
        return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n * 2))
    return "".join(rng.choice("abcdefxyz0123(){};=.,") for _ in range(n * 6))


def test_unspaced_passages(spark):
    rng = random.Random(5)
    docs, passages = [], {}
    for k in range(200):
        kind = ("cjk", "code")[k % 2]
        passages[k] = unspaced(rng, kind, 51)
        docs += [(2 * k + i, unspaced(rng, kind, 30 + i) + passages[k] + unspaced(rng, kind, 30)) for i in (0, 1)]
    whole = unspaced(rng, "cjk", 300)
    docs += [(1000, whole), (1001, whole), (1002, unspaced(rng, "cjk", 300)), (1003, unspaced(rng, "code", 300))]
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k + i].shared_chunks for k in passages for i in (0, 1))
    assert all(got[2 * k + 1].first_docs == [2 * k] and got[2 * k].text == docs[2 * k][1] for k in passages)
    assert got[1001].text == "" and got[1000].text == whole
    assert got[1002].shared_chunks == got[1003].shared_chunks == 0
