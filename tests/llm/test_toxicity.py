"""Learning by noisy-or: planted sentences, held-out documents, gradients, odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigseg.llm import queries as Q
from sigseg.llm import textops as T
from sigseg.llm import toxicity as X

BAD = ["idiot", "scum", "Trottel", "nulité"]


def planted(n, seed=3):
    """Texts of sentences of invented words; a third have one bad word in one sentence."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdegilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 15))) for _ in range(rng.randrange(2, 12))]
        toxic = i % 3 == 0
        at = rng.randrange(len(sentences))
        if toxic:
            sentences[at] += " " + rng.choice(BAD)
        starts = np.cumsum([0] + [len(s) + 2 for s in sentences])
        out.append((i, ". ".join(sentences) + ".", int(toxic), (int(starts[at]), int(starts[at]) + len(sentences[at]))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = planted(900)
    return X.learn_toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int"))


def test_finds_documents_and_sentences(spark, model):
    rows = planted(300, seed=8)
    rows = [(i, t.upper() if i % 5 == 0 else t, y, at) for i, t, y, at in rows]
    got = {r.doc_id: r for r in X.score_toxicity(spark.createDataFrame([(r[0], r[1], 1.0) for r in rows], "doc_id long, text string, score double").repartition(3), model).collect()}
    assert len(got) == 300
    for i, _, toxic, at in rows:
        assert got[i].predicted == toxic == int(got[i].score >= 0.5)
        assert [(s.start, s.end) for s in got[i].sentences] == ([at] if toxic else [])


def test_scores_equal_a_plain_noisy_or(spark, model):
    text = "Das ist ein Trottel. Nein! Scum idiot\nGut und schön? Ende"
    row = X.score_toxicity(spark.createDataFrame([(text,)], "text string"), model).first()
    alone = [r.score for r in X.score_toxicity(spark.createDataFrame([(t,) for t in ("Das ist ein Trottel", "Nein", "Scum idiot", "Gut und schön", "Ende")], "text string").coalesce(1), model).collect()]
    assert row.score == pytest.approx(1 - np.prod(1 - np.array(alone)), abs=1e-9)
    assert [text[s.start : s.end] for s in row.sentences] == ["Das ist ein Trottel", "Scum idiot"]


def test_odd_inputs(spark, model):
    long = "gut und " * 200_000 + "idiot " + "und gut " * 10
    assert len(long) > T.SLICE_BYTES
    rows = [(1, None), (2, ""), (3, "12 !! ..."), (4, long), (4, long), (None, "scum"), (6, "é"), (7, "\n\n")]
    got = X.score_toxicity(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, predicted int, sentences string"), model).collect()
    assert sorted(((r.doc_id or 0), r.predicted) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (6, 0), (7, 0)]
    for r in got:
        assert 0 <= r.score <= 1 and (r.score == 0.0 or r.text is not None)
    at = next(r for r in got if r.doc_id == 4).sentences
    assert len(at) == 1 and "idiot" in long[at[0].start : at[0].end]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.score_toxicity(none, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 0), (3, 7)], "doc_id long, label int")
    for docs in (none, spark.createDataFrame([r[:2] for r in rows[:4]], "doc_id long, text string")):
        untaught = X.learn_toxicity(docs, labels)
        assert [r.score for r in X.score_toxicity(docs, untaught).collect()] == [0.0] * docs.count()


def test_draw_is_bounded_and_repeats_teach_once(spark):
    docs = spark.range(5000).select((F.col("id") % 2500).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(5000).select((F.col("id") % 2500).alias("doc_id"), (F.col("id") >= 2500).cast("int").alias("label"))
    drawn = X._draw(docs, labels, 500).collect()
    assert 350 < len(drawn) <= 500 and all(r.label == 1 for r in drawn) and len({r.doc_id for r in drawn}) == len(drawn)
    assert all(r.text == min(f"t{r.doc_id}", f"t{r.doc_id + 2500}") for r in drawn)


def test_likelihood_ratio(spark):
    got = spark.createDataFrame([(8, 2), (0, 5), (5, 0), (10, 90)], "n1 long, n0 long").select(X._g2(10, 90)).collect()
    assert got[2][0] > 12 and got[1][0] < 0 and abs(got[3][0]) < 1e-9
    table = np.array([[8, 2], [2, 88]])
    expected = table.sum(1)[:, None] * table.sum(0)[None, :] / 100
    assert got[0][0] == pytest.approx(2 * (table * np.log(table / expected)).sum())


def test_features_are_counted_once_a_sentence():
    x = X.sentences(pa.array(["ab ab ab. ab", None, "É ab", "漢字漢字漢字漢字漢字。漢字"]))
    assert np.bincount(x.text).tolist() == [2, 0, 1, 2]
    assert len(np.unique(x.sentence * X.BUCKETS + x.feature)) == len(x.feature)
    assert set(x.feature[x.text[x.sentence] == 2]) == set(X.sentences(pa.array(["é AB"])).feature)


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    marked = Q.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic is not null and held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in marked.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01
