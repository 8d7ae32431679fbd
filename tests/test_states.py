"""Numbers of states in planted mixtures, and clusters against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigseg.operators import multichannel as M


def planted(centers, n, spread, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, spread, (n, len(c))) for c in centers])


def frame(spark, points):
    return spark.createDataFrame([("a", i, [float(v) for v in x]) for i, x in enumerate(points)], "chrom string, bin long, x array<double>").repartition(3)


CASES = [
    [(0.0, 0.0)],
    [(0.0, 0.0), (8.0, 0.0)],
    [(0.0, 0.0), (8.0, 0.0), (4.0, 9.0)],
    [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0), (0.0, 9.0, 0.0), (0.0, 0.0, 9.0), (9.0, 9.0, 9.0)],
]


@pytest.mark.parametrize("centers", CASES)
def test_finds_the_true_number(spark, centers):
    found = M.select_states(frame(spark, planted(centers, 300, 1.0)))
    assert len(found.means) == len(centers)
    near = np.sqrt(((found.means[:, None] - np.array(centers)) ** 2).sum(2))
    assert sorted(near.argmin(1)) == list(range(len(centers))) and near.min(1).max() < 0.4
    assert np.allclose(found.weights / found.weights.sum(), 1 / len(centers), atol=0.05)
    norms = np.linalg.norm(found.means, axis=1)
    assert (np.diff(norms) >= 0).all()


def shares(x, means):
    out = []
    for p in x:
        d2 = [sum((a - b) ** 2 for a, b in zip(p, m, strict=True)) for m in means]
        scale = max(d2) + sum(d2) / len(d2)
        w = [math.exp(-min(1000 * v / max(scale, 1e-300), 500)) for v in d2]
        out.append([v / sum(w) for v in w])
    return np.array(out)


def settle(x, means, rounds):
    for _ in range(rounds):
        w = shares(x, means)
        new = np.array([(w[:, j, None] * x).sum(0) / w[:, j].sum() for j in range(len(means))])
        still = np.allclose(new, means, atol=1e-9)
        means = new
        if still:
            break
    w = shares(x, means)
    covariances = []
    for j in range(len(means)):
        m = (w[:, j, None] * x).sum(0) / w[:, j].sum()
        covariances.append(sum(w[i, j] * np.outer(p - m, p - m) for i, p in enumerate(x)) / w[:, j].sum())
    return w.sum(0), means, covariances


def apart(a, i, b, j):
    line = a[1][i] - b[1][j]
    length = math.sqrt(line @ line)
    unit = line / max(length, 1e-300)
    va, vb = unit @ a[2][i] @ unit, unit @ b[2][j] @ unit
    return length / math.sqrt((a[0][i] * va + b[0][j] * vb) / (a[0][i] + b[0][j]))


def merge(c):
    pairs = sorted((apart(c, i, c, j), i, j) for i in range(len(c[1])) for j in range(i + 1, len(c[1])))
    gone, new = set(), []
    for d, i, j in pairs:
        if d < M.APART and not {i, j} & gone:
            gone |= {i, j}
            new.append((c[0][i] * c[1][i] + c[0][j] * c[1][j]) / (c[0][i] + c[0][j]))
    return np.array([m for i, m in enumerate(c[1]) if i not in gone] + new)


def test_selection_equals_plain_loops(spark):
    points = planted([(0.0, 1.0), (7.0, 2.0), (3.0, 8.0)], 60, 1.2, 4)
    df = frame(spark, points)
    order = {r.bin: (r.h, r.half) for r in df.select("bin", M._order(1).alias("h"), F.pmod(M._order(2), F.lit(2)).alias("half")).collect()}
    sample = points[sorted(order, key=lambda i: order[i][0])[: 2 * M.FIRST_POINTS]]
    chosen = [0]
    while len(chosen) < 4:
        chosen.append(int(np.argmax([min(((p - sample[c]) ** 2).sum() for c in chosen) for p in sample])))
    halves = [points[[i for i in range(len(points)) if order[i][1] == h]] for h in (0, 1)]
    means = [sample[chosen], sample[chosen]]
    while True:
        found = [settle(x, m, 10) for x, m in zip(halves, means, strict=True)]
        means = [merge(c) for c in found]
        if all(len(m) == len(c[1]) for m, c in zip(means, found, strict=True)):
            break
    a, b = found
    d = np.array([[apart(a, i, b, j) for j in range(len(b[1]))] for i in range(len(a[1]))])
    start = [(a[0][i] * a[1][i] + b[0][j] * b[1][j]) / (a[0][i] + b[0][j]) for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i and d[i, j] < M.APART]
    n, m, c = settle(points, np.array(start), 10)
    at = np.argsort(np.linalg.norm(m, axis=1))
    got = M.select_states(df)
    assert np.allclose(got.means, m[at], atol=1e-7) and np.allclose(got.weights, n[at]) and np.allclose(got.covariances, np.array(c)[at], atol=1e-6)


def test_soft_clusters_and_edges(spark):
    points = planted([(0.0, 1.0), (7.0, 2.0)], 30, 1.0, 6)
    df = frame(spark, points)
    order = {r.bin: r.h for r in df.select("bin", M._order(3).alias("h")).collect()}
    n, m, c = settle(points, points[sorted(order, key=order.get)[:3]], 4)
    at = np.argsort(np.linalg.norm(m, axis=1))
    means, covariances, weights = M.soft_clusters(df, 3, 4, 3)
    assert np.allclose(means, m[at], atol=1e-7) and np.allclose(weights, (n / n.sum())[at]) and np.allclose(covariances, np.array(c)[at], atol=1e-6)
    same = M.select_states(frame(spark, np.ones((20, 2))))
    assert same.means.tolist() == [[1.0, 1.0]] and np.allclose(same.covariances, 0)
    with pytest.raises(ValueError, match="no points"):
        M.select_states(frame(spark, points).limit(0))


def test_segmenter_selects_its_states(spark):
    rng = np.random.default_rng(2)
    state = np.repeat(rng.integers(0, 3, 40), 15)
    points = np.array([(0.0, 0.0), (8.0, 0.0), (4.0, 9.0)])[state] + rng.normal(0, 1, (600, 2))
    made = M.fit_segmenter(frame(spark, points), dims=2, rounds=2)
    assert made.fit.model.n_states == 3
