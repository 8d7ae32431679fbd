"""Many models in one job, runs from the walk, and training in log space."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import em
from sigseg.operators import hmm as H
from sigseg.operators import signal as S
from tests.test_hmm import MODEL, OBS, casino, packed

LOADED = H.HmmModel([0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], E.Discrete([[1 / 6] * 6, [0.1] * 5 + [0.5]]), [0.5, 0.5])


@pytest.mark.parametrize("chunk", [1, 2, 3, 64, 1000])
def test_runs_of_the_walk_equal_runs_of_the_bins(spark, chunk):
    data = packed(spark, {"a": casino(700)[1], "b": casino(129, 3)[1], "c": [5], "d": [5] * 256}, chunk)
    expected = {tuple(r) for r in S.runs(H.viterbi(data, LOADED)).select("chrom", "region", "start", "length", "state").collect()}
    got = H.viterbi_runs(data, LOADED).select("chrom", "region", "start", "length", "state").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_cells_decode_and_score_as_alone(spark):
    other = H.HmmModel([0.2, 0.3, 0.5], [[0.2, 0.4, 0.4], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]], E.Discrete([[0.2, 0.3, 0.5], [0.5, 0.3, 0.2], [0.1, 0.1, 0.8]]))
    models = {"x|y": MODEL, "z": other}
    rows = [(cell, c, i, o) for cell in models for c, x in OBS.items() for i, o in enumerate(x)]
    both = H.pack(spark.createDataFrame(rows, "cell string, chrom string, bin long, obs int"), chunk=2, keys=("cell", "chrom"))
    states = H.viterbi(both, models, keys=("cell", "chrom")).collect()
    runs = H.viterbi_runs(both, models, keys=("cell", "chrom")).collect()
    likelihood = {r.cell: r.loglik for r in H.log_likelihood_cells(both, models).collect()}
    for cell, model in models.items():
        data = packed(spark, OBS, 2)
        assert {(r.chrom, r.bin, r.state) for r in states if r.cell == cell} == {tuple(r) for r in H.viterbi(data, model).collect()}
        assert sorted((r.chrom, r.region, r.start, r.length, r.state) for r in runs if r.cell == cell) == sorted(tuple(r) for r in H.viterbi_runs(data, model).collect())
        assert likelihood[cell] == pytest.approx(sum(r.loglik for r in H.log_likelihood(data, model).collect()))


@pytest.mark.parametrize("chunk", [7, 1000])
def test_training_in_log_space_equals_scaled(spark, chunk):
    data = packed(spark, {"a": casino(300)[1], "b": casino(90, 5)[1]}, chunk)
    one, two = (em.baum_welch(data, LOADED, em.Iterations(3), smoothing=s, learn_end=True) for s in ("full", "log"))
    assert two.likelihoods == pytest.approx(one.likelihoods, abs=1e-9)
    for a, b in ((one.model.start, two.model.start), (one.model.end, two.model.end), (one.model.transition, two.model.transition), (one.model.emission.table, two.model.emission.table)):
        assert np.allclose(a, b, atol=1e-9)
    cells = {"p": LOADED, "q": em.random_discrete(2, 6, 1)}
    copies = data.withColumn("cell", F.explode(F.array(F.lit("p"), F.lit("q")))).withColumn("seq", F.concat_ws("\x1f", "cell", "seq"))
    fits = em.baum_welch_cells(copies, cells, 2, smoothing="log")
    for c, m in cells.items():
        alone = em.baum_welch(data, m, em.Iterations(2), smoothing="log")
        assert fits[c].likelihoods == pytest.approx(alone.likelihoods) and np.allclose(fits[c].model.transition, alone.model.transition)


def test_log_space_keeps_what_the_scaled_pass_loses(spark):
    """Two states that never change; what only the second can give comes last, after its probability has fallen below the least double."""
    tiny = 1e-200
    model = H.HmmModel([0.5, 0.5], [[1.0, 0.0], [0.0, 1.0]], E.Discrete([[1 - tiny, 0.0, tiny], [tiny, 0.5, 0.5]]))
    data = packed(spark, {"a": [0, 0, 0, 1]}, 2)
    with pytest.raises(ValueError, match="finite"):
        em.baum_welch(data, model, em.Iterations(1))
    fit = em.baum_welch(data, model, em.Iterations(1), smoothing="log")
    assert fit.likelihoods[0] == pytest.approx(math.log(0.5) * 2 + 3 * math.log(tiny))
    assert fit.model.start == pytest.approx([0, 1]) and fit.model.emission.table[1] == pytest.approx([0.75, 0.25, 0])
    with pytest.raises(ValueError, match="finite"):
        em.baum_welch(packed(spark, {"a": [0, 1]}, 2), H.HmmModel([1.0, 0.0], model.transition, model.emission), em.Iterations(1), smoothing="log")


def test_random_start_is_a_model():
    m = em.random_discrete(3, 5, 2)
    assert np.allclose([sum(m.start), sum(m.end), *map(sum, m.transition), *map(sum, m.emission.table)], 1)
    assert m == em.random_discrete(3, 5, 2) != em.random_discrete(3, 5, 3)
