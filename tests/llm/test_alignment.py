"""Alignments against plain loops over whole texts and the two libraries."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sigseg.llm import alignment as A
from sigseg.llm import queries as Q
from sigseg.llm import shared
from tests.llm.test_tokens import odd_texts


def libraries():
    a = Tokenizer.from_str(Q.tokenizer_spec())
    a.encode_special_tokens = True
    byte_of = A.Vocabulary(Q.tokenizer_spec()).label
    b = sentencepiece.SentencePieceProcessor(model_proto=Q.piece_model())

    def ids_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [byte_of[i] for i in ids]

    def ids_b(text):
        ids = b.encode(text)
        pieces = [b.id_to_piece(i) for i in ids]
        return ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]

    return ids_a, ids_b


def brute(texts, kind):
    ids_a, ids_b = libraries()
    found, counts = [], Counter()
    for text in texts:
        (a, sa), (b, sb) = (ids_a(text), ids_b(text)) if text else (([], []), ([], []))
        if text and not b"".join(sa) == b"".join(sb) == (" " + text).encode():
            a, b = [], []
        spans = []
        for ids, pieces in ((a, sa), (b, sb)):
            at, out = 0, []
            for i, p in zip(ids, pieces, strict=False):
                out.append((i, at, at + len(p)))
                at += len(p)
            spans.append(out)
        shared_ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        group = lambda e: next(k for k, x in enumerate(shared_ends) if x >= e)  # noqa: B023, E731
        sides = [[[] for _ in shared_ends] for _ in range(2)]
        for side, tokens in zip(sides, spans, strict=True):
            for i, _, e in tokens:
                side[group(e)].append(i)
        if kind == "end":
            by_end = {e: i for i, _, e in spans[1]}
            links = [(i, by_end[e]) for i, _, e in spans[0] if e in by_end]
        elif kind == "overlap":
            links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        else:
            links = [(i, j) for x, y in zip(*sides, strict=True) for i in x for j in y]
        counts.update(links)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*sides, strict=True))
        found.append((len(a), len(b), len(shared_ends), links, text_of))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), t) for a, b, g, links, t in found]


@pytest.mark.parametrize("kind", A.KINDS)
def test_links_equal_plain_loops(spark, kind, monkeypatch):
    texts = [t for t in odd_texts() if t is None or len(t) < 2000][:260] + ["a▁b", " a", "a ", "  ", " ", "\t", "the cat sat on the mat", "the cat sat on the mat", "<s>x</s><|endoftext|>", "\x00é́"]
    expected = brute(texts, kind)
    assert sum(e[0] == 0 for e in expected) == 3
    df = spark.createDataFrame([(i % 250, i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, place int, text string, links string, n_a int").repartition(3)
    for limit in (A.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(A, "BROADCAST_PAIRS", limit)
        monkeypatch.setattr(shared, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(shared, "HOT_ROWS", 5)
        monkeypatch.setattr(A, "LINKS", 50)
        got = A.cross_tokenizer_links(df, Q.tokenizer_spec(), Q.piece_model(), kind).collect()
        rows = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got)
        assert rows == sorted((i % 250, *e) for i, e in enumerate(expected))


def test_query_and_long_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in Q.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()}
    for (i, _), (a, b, g, n, best, total, text) in zip(rows, brute([t for _, t in rows], "end"), strict=True):
        assert tuple(got[i]) == (i, a, b, g, n, best, total, hashlib.sha256(text.encode()).hexdigest() if text else "")
    long = "ab Cd é\n" * 200_000
    ids_a, ids_b = libraries()
    one = A.cross_tokenizer_links(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"), Q.tokenizer_spec(), Q.piece_model(), digest=True).orderBy("doc_id").collect()
    assert (one[0].n_a, one[0].n_b) == (len(ids_a(long)[0]), len(ids_b(long)[0])) and tuple(one[1])[1:] == (0, 0, 0, 0, "", 0, 0)
    assert A.cross_tokenizer_links(spark.createDataFrame([], "doc_id long, text string"), Q.tokenizer_spec(), Q.piece_model()).count() == 0


def test_few_pieces_are_encoded_at_once(monkeypatch):
    met, flat_ids = [], A._flat_ids
    monkeypatch.setattr(A, "_flat_ids", lambda found: met.append(len(found)) or flat_ids(found))
    text = " " + " ".join(f"w{i:05d}x" for i in range(20_000))
    side = A.byte_level(Q.tokenizer_spec())
    ids, off = side.encode(pa.array([text, ""], pa.large_utf8()))
    assert max(met) <= 4096 and sum(met) > 4096
    assert b"".join(side.bytes[side.start[i] : side.start[i] + side.length[i]].tobytes() for i in ids.tolist()) == text.encode() and off.tolist() == [0, len(ids), len(ids)]
