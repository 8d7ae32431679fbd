import itertools
import math

import numpy as np
import pytest

from sigseg.functions import emissions as E
from sigseg.operators import em
from sigseg.operators import hmm as H

MODEL = H.HmmModel([0.5, 0.3, 0.2], [[0.7, 0.2, 0.1], [0.3, 0.4, 0.3], [0.2, 0.2, 0.6]], E.Discrete([[0.6, 0.3, 0.1], [0.1, 0.7, 0.2], [0.3, 0.3, 0.4]]), [0.2, 0.5, 0.3])
OBS = {"a": [0, 2, 1, 1, 0, 2, 2], "b": [1], "c": [2, 0, 0]}


def packed(spark, obs, chunk, kind="int"):
    rows = [(c, i, o) for c, x in obs.items() for i, o in enumerate(x)]
    return H.pack(spark.createDataFrame(rows, f"chrom string, bin long, obs {kind}").repartition(3), chunk=chunk)


def enumerate_paths(x, use_end=False):
    k, out = 3, {}
    for path in itertools.product(range(k), repeat=len(x)):
        p = MODEL.start[path[0]] * math.prod(MODEL.transition[i][j] for i, j in itertools.pairwise(path))
        out[path] = p * math.prod(MODEL.emission.table[s][o] for s, o in zip(path, x, strict=True)) * (MODEL.end[path[-1]] if use_end else 1)
    return out


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_recursions_equal_enumeration(spark, chunk):
    data = packed(spark, OBS, chunk)
    likelihood = {r.chrom: r.loglik for r in H.log_likelihood(data, MODEL).collect()}
    ends = {r.chrom: r.loglik for r in H.log_likelihood(data, MODEL, use_end=True).collect()}
    gamma = {s: {(r.chrom, r.bin): r.gamma for r in H.posterior(data, MODEL, s).collect()} for s in ("full", "lag1", "filter")}
    best = {(r.chrom, r.bin): r.state for r in H.viterbi(data, MODEL).collect()}
    for c, x in OBS.items():
        assert likelihood[c] == pytest.approx(math.log(sum(enumerate_paths(x).values())))
        assert ends[c] == pytest.approx(math.log(sum(enumerate_paths(x, True).values())))
        paths = enumerate_paths(x, True)
        assert tuple(best[c, i] for i in range(len(x))) == max(paths, key=paths.get)
        for t in range(len(x)):
            for smoothing, to in (("full", len(x)), ("lag1", min(t + 2, len(x))), ("filter", t + 1)):
                part = enumerate_paths(x[:to])
                mass = [sum(p for path, p in part.items() if path[t] == s) for s in range(3)]
                assert gamma[smoothing][c, t] == pytest.approx([m / sum(mass) for m in mass])


def test_fold_equals_scan(spark):
    data = packed(spark, OBS, 100)
    assert {r.chrom: r.loglik for r in H.fold_log_likelihood(data, MODEL).collect()} == pytest.approx({r.chrom: r.loglik for r in H.log_likelihood(data, MODEL).collect()})


def casino(n, seed=42):
    """A die that is loaded now and then."""
    rng, state, states = np.random.default_rng(seed), 0, []
    for _ in range(n):
        state = state if rng.random() < (0.95, 0.9)[state] else 1 - state
        states.append(state)
    rolls = [int(rng.choice(6, p=[1 / 6] * 6 if s == 0 else [0.1] * 5 + [0.5])) for s in states]
    return states, rolls


CASINO = H.HmmModel([1.0 - 1e-8, 1e-8], [[0.95, 0.05], [0.1, 0.9]], E.Discrete([[1 / 6] * 6, [0.1] * 5 + [0.5]]))


def test_casino_is_decoded_and_learned(spark):
    truth, rolls = casino(6000)
    data = packed(spark, {"die": rolls}, 512)
    states = [r.state for r in H.viterbi(data, CASINO).orderBy("bin").collect()]
    assert np.mean(np.array(states) == truth) > 0.7
    first = H.HmmModel(CASINO.start, [[0.75, 0.25], [0.1, 0.9]], CASINO.emission)
    fit = em.baum_welch(data, first, em.Iterations(8))
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(fit.likelihoods))
    assert fit.model.transition[0][0] > 0.85
    assert fit.model.emission.table[1][5] > 0.4
    assert H.HmmModel.from_json(fit.model.to_json()) == fit.model


@pytest.mark.parametrize("kind", ["normal", "mixture", "multinomial", "mvn"])
def test_other_families_improve(spark, kind):
    rng = np.random.default_rng(1)
    truth, _ = casino(800)
    emission, value, sql = {
        "normal": (E.Normal([2.0, 5.0], [2.0, 1.0]), lambda s: float(rng.normal(*((3, 1), (6, 2))[s])), "double"),
        "mixture": (E.Mixture([[0.5, 0.5], [0.5, 0.5]], [[2.0, 8.0], [5.0, 7.0]], [[2.0, 1.0], [1.0, 2.0]]), lambda s: float(rng.normal(*((3, 1), (6, 2))[s])), "double"),
        "multinomial": (E.Multinomial([[[0.6, 0.4], [0.5, 0.5]], [[0.4, 0.6], [0.3, 0.7]]]), lambda s: [int(rng.random() < (0.2, 0.8)[s]), int(rng.random() < (0.3, 0.7)[s])], "array<int>"),
        "mvn": (E.MultivariateNormal([[2.1, 1.8], [5.0, 5.1]], [[[1.0, 0.0], [0.0, 1.0]]] * 2), lambda s: rng.normal(((3, 3.2), (6.3, 6))[s], (1, 2)[s]).tolist(), "array<double>"),
    }[kind]
    data = packed(spark, {"x": [value(s) for s in truth], "y": [value(s) for s in truth[:300]]}, 128, sql)
    fit = em.baum_welch(data, H.HmmModel([0.9, 0.1], [[0.9, 0.1], [0.2, 0.8]], emission), em.Iterations(5))
    assert fit.likelihoods[-1] > fit.likelihoods[0]
    state = {(r.chrom, r.bin): r.state for r in H.viterbi(data, fit.model).collect()}
    assert np.mean([state["x", i] == s for i, s in enumerate(truth)]) > 0.8


def test_self_transition_floor_and_stop():
    a = em.with_floor(np.array([[0.5, 0.3, 0.2], [0.0, 0.9, 0.1], [0.1, 0.0, 0.9]]), 0.8)
    assert a.sum(1) == pytest.approx([1, 1, 1])
    assert (np.diag(a) >= 0.8 - 1e-12).all()
    assert (a >= 0).all()
    stop = em.SmallChange(1.0)
    assert [stop(v) for v in (0, 5, 5.5, 5.6, 5.7)] == [False, False, False, False, True]


def test_sequence_without_likelihood_is_left_out(spark):
    never = E.Discrete([[1.0, 0.0], [1.0, 0.0]])
    model = H.HmmModel([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], never)
    fit = em.baum_welch(packed(spark, {"fine": [0, 0, 0], "bad": [0, 1, 0]}, 2), model, em.Iterations(1))
    assert math.isfinite(fit.likelihoods[0])
    with pytest.raises(ValueError, match="finite"):
        em.expect(packed(spark, {"bad": [0, 1, 0]}, 2), model)
