import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sigseg.llm import queries as Q
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_near_dup import brute as brute_near
from tests.llm.test_quality_rules import brute as brute_quality


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {i: d for i, d in docs.items() if brute_quality(d[0])[-1]}
    docs = {i: (text, docs[i][1]) for i, _, _, text in brute_lines([(i, t) for i, (t, _) in docs.items()], 40, 5)}
    kept = {i for i, _, _, first in brute_near([(i, t) for i, (t, _) in docs.items()], 5, 80) if first}
    docs = {i: d for i, d in docs.items() if i in kept}
    mixed = brute_mix([(i, t, s) for i, (t, s) in docs.items()], 2.0, 1 << 22)
    library = Tokenizer.from_str(Q.tokenizer_spec())
    expected = []
    for i, source, _, _ in mixed:
        ids = np.array(library.encode(docs[i][0], add_special_tokens=False).ids, "<u4")
        expected.append((i, source, len(ids), ids.tobytes(), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[i][0].encode()).hexdigest()))
    got = [(r.doc_id, r.source, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(expected)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good, "en", "a", 1), (2, good, "en", "a", 1), (None, good, None, None, None), (3, None, None, "b", 0), (4, "", "en", "b", 0), (5, good + " tail", "en", None, 5)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id is not null"), "").collect()) == [1, 3, 4]
    assert corpus_pipeline.drop_near_copies(spark, docs, "").filter("doc_id is null").count() == 1
    assert corpus_pipeline.tokenize(spark, docs, "").count() == 6
