import itertools
import math

import numpy as np
import pytest

from sigseg.operators import wavelet as W

MODEL = W.TreeModel([0.7, 0.3], [[0.8, 0.2], [0.3, 0.7]], [0.0, 1.5], [1.0, 0.7])


def enumerate_tree(x):
    """Posterior of state 1 and best states by all assignments. x[(level, idx)]."""
    nodes, top = sorted(x), max(level for level, _ in x)
    density = lambda v, s: math.exp(-((v - MODEL.means[s]) ** 2) / (2 * MODEL.deviations[s] ** 2)) / (MODEL.deviations[s] * math.sqrt(2 * math.pi))
    total, ones, best = 0.0, dict.fromkeys(nodes, 0.0), (-1, None)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        s = dict(zip(nodes, states, strict=True))
        p = math.prod(density(x[n], s[n]) * (MODEL.root[s[n]] if n[0] == top else MODEL.transition[s[n[0] + 1, n[1] // 2]][s[n]]) for n in nodes)
        total += p
        for n in nodes:
            ones[n] += p * s[n]
        best = max(best, (p, states), key=lambda b: b[0])
    return {n: v / total for n, v in ones.items()}, dict(zip(nodes, best[1], strict=True))


@pytest.mark.parametrize("tier", [12, 1, 2])
def test_tree_equals_enumeration(spark, monkeypatch, tier):
    monkeypatch.setattr(W, "TIER", tier)
    rng = np.random.default_rng(1)
    x = {(level, i): float(rng.normal(0.7, 1)) for level in (1, 2, 3) for i in range(2 ** (3 - level))}
    tree = spark.createDataFrame([("c", level, i, v) for (level, i), v in x.items()], "chrom string, level int, idx long, detail double")
    gamma, best = enumerate_tree(x)
    got = {(r.level, r.idx): r.gamma[1] for r in W.tree_posterior(tree, MODEL).collect()}
    assert got == pytest.approx(gamma)
    assert {(r.level, r.idx): r.state for r in W.tree_viterbi(tree, MODEL).collect()} == best


def test_pyramid_round_trip(spark):
    values = [float(v) for v in np.random.default_rng(2).normal(size=12)]
    signal = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "chrom string, bin long, value double")
    for filters in (W.MEAN, W.HAAR):
        got = {r.bin: r.value for r in W.idwt(W.dwt(signal, filters), filters).collect()}
        assert got == pytest.approx({i: values[i] if i < 12 else 0.0 for i in range(16)})
