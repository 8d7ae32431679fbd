import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sigseg.llm import queries as Q
from sigseg.llm.bpe_automaton import bpe_decode, bpe_encode
from sigseg.llm.elias_fano import EliasFano
from sigseg.llm.pretokenize import BatchEncoder
from sigseg.llm.token_files import read_documents, read_token_files, write_token_files


def odd_texts():
    rng = random.Random(1)
    letters = " \n\t'stredvmlaéßñ漢字1২x!?.,-_<|>🙂 \u0085"
    fixed = ["", None, " ", "\n\n", "a  b", "don't 'tis 's ''s !'s  x\n's I'LL we'll", "<|endoftext|>a <|endoftext|><|endoftext|> <|endoftext", "aaa" * 50, " " * 200, "dd d ddd dddd ddddd", "a" * 5000]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["<|endoftext|>"]


def test_automaton_equals_the_library(spark):
    texts = odd_texts()
    spec, library = Q.tokenizer_spec(), Tokenizer.from_str(Q.tokenizer_spec())
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    for packed in (False, True):
        for r in bpe_decode(bpe_encode(df, spec, packed=packed), spec).collect():
            ids = np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids
            expected = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert ids == expected
            assert r.decoded == library.decode(expected, skip_special_tokens=False) == (texts[r.doc_id] or "")
    both = bpe_encode(df.withColumnRenamed("ids", "decoded"), spec, decoded="decoded")
    assert {r.doc_id: r.decoded for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
    broken = bpe_decode(spark.createDataFrame([([220, 162],), ([],), (None,)], "ids array<int>"), spec)
    assert [r.decoded for r in broken.collect()] == [library.decode([220, 162]), "", ""]


def test_queries_equal_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = Tokenizer.from_str(Q.tokenizer_spec())
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op6_bpe_encode_decode(spark, sf).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    start, expected = 0, {}
    for i in sorted(ids):
        x = [*ids[i], 0]
        expected[i] = (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op10_token_files(spark, sf).collect()} == expected


def test_token_files_edges(spark, tmp_path):
    spec = Q.tokenizer_spec()
    rows = [(3, "b b"), (1, None), (3, "b b"), (None, "x"), (2, "long " * 300), (3, "a"), (7, "")]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spec, f"file://{tmp_path}/a", block_tokens=100)
    got = sorted(read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3, 7]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    chosen = read_documents(spark, f"file://{tmp_path}/a", [3, 99, 1, -5])
    assert sorted((tuple(r) for r in chosen.collect()), key=lambda r: r[1]) == [tuple(r) for r in got if r.doc_id in (1, 3)]
    assert read_documents(spark, f"file://{tmp_path}/a", []).count() == 0
    write_token_files(spark.createDataFrame([], "doc_id long, text string, ids int"), spec, f"file://{tmp_path}/b")
    assert read_token_files(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.integers(0, [1, 3, 1000, 10**6][seed], rng.integers(1, 700)))
    code = EliasFano.encode(values)
    assert (code.all() == values).all()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    for x in (0, 1, int(values[0]), int(values[-1]), int(values[-1]) + 1, int(values[len(values) // 2])):
        assert code.first_not_below(x) == int((values < x).sum())
    wide = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert EliasFano.encode(wide).all().tolist() == wide.tolist()
    assert len(EliasFano.encode(values[:0]).all()) == 0


def test_cache_forgets_the_oldest_half(monkeypatch):
    import pyarrow as pa

    from sigseg.llm import pretokenize

    monkeypatch.setattr(pretokenize, "CACHE_PIECES", 50)
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32), np.array([len(p) for p in pieces])

    encoder = BatchEncoder(pretokenize.Vocabulary(Q.tokenizer_spec()), encode)
    rng = random.Random(1)
    for turn in range(60):
        texts = ["".join(f" {rng.choice('abc')}{rng.randrange(5)} w{rng.randrange(turn, turn + 30)}" for _ in range(6)) for _ in range(3)]
        ids, off = encoder(pa.array(texts))
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(off[:-1], off[1:], strict=True)] == texts
        assert len(encoder.known) <= 50 + 40
    assert len(asked) > len(set(asked)) > 80
