"""Many channels at each position: principal components, soft clusters and Gaussian models.

Rows are chrom, bin, x (``array<double>``). Fits take one aggregate for each
round; what reaches the driver is d x d numbers for d channels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators.em import Fit, Iterations, baum_welch
from sigseg.operators.hmm import HmmModel, pack


def moments(data: DataFrame, weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, sums and sums of products of the channels: each task sums its batches in numpy and hands on d + d * d + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w, lists = batch.column(0).to_numpy(), batch.column(1)
            x = np.asarray(lists.flatten()).reshape(batch.num_rows, -1)
            part = np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    keyed = data.select((F.lit(1.0) if weight is None else weight).alias("w"), F.col("x").cast("array<double>").alias("x")).filter("x is not null and size(x) > 0")
    sums = keyed.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    if not sums:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    flat = np.array([r["v"] for r in sums])
    d = int((math.isqrt(4 * len(flat) - 3) - 1) // 2)
    return float(flat[0]), flat[1 : 1 + d], flat[1 + d :].reshape(d, d)


@dataclass(frozen=True)
class Pca:
    """Mean, components (rows, by falling variance) and their share of the variance."""

    mean: list[float]
    components: list[list[float]]
    energy: list[float]

    def transform(self, x: Column) -> Column:
        """Components of a vector."""
        return F.array(*[_dot(x, row, self.mean) for row in self.components])

    def recover(self, y: Column) -> Column:
        """The vector that components stand for."""
        back = np.asarray(self.components).T
        return F.array(*[_dot(y, row, np.zeros(len(row))) + float(m) for row, m in zip(back, self.mean, strict=True)])


def _dot(x: Column, row: list[float], mean: list[float]) -> Column:
    """Product of a vector less the mean with a fixed row."""
    shift = -float(np.dot(row, mean))
    return F.aggregate(F.zip_with(x, F.lit([float(v) for v in row]), lambda a, b: a * b), F.lit(shift), lambda a, b: a + b)


def fit_pca(data: DataFrame, dims: int | None = None, min_energy: float = 0.9) -> Pca:
    """The first components, as many as asked for or as reach the share of the variance. Signs make the largest entry positive."""
    n, s, p = moments(data)
    mean = s / n
    values, vectors = np.linalg.eigh(p / n - np.outer(mean, mean))
    order = np.argsort(-values)
    values, rows = np.maximum(values[order], 0), vectors[:, order].T
    rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    share = values / max(values.sum(), 1e-300)
    k = dims or int(np.searchsorted(np.cumsum(share), min_energy - 1e-12) + 1)
    return Pca(mean.tolist(), rows[:k].tolist(), share[:k].tolist())


def _soft(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Each point's share in each cluster: exp(-min(1000 d2 / (largest + mean d2), 500)), normalised."""
    d2 = ((x[:, None, :] - means) ** 2).sum(2)
    scale = np.maximum(d2.max(1) + d2.mean(1), 1e-300)
    w = np.exp(-np.minimum(1000 * d2 / scale[:, None], 500))
    return w / w.sum(1, keepdims=True)


@dataclass(frozen=True)
class Clusters:
    """Weight (sum of shares), mean and covariance of soft clusters."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def ordered(self) -> Clusters:
        """By the norm of the mean."""
        at = np.argsort(np.linalg.norm(self.means, axis=1), kind="stable")
        return Clusters(self.weights[at], self.means[at], self.covariances[at])


def _cluster(data: DataFrame, means: dict[int, np.ndarray]) -> dict[int, Clusters]:
    """The clusters of each part (``part``, ``x``) by its means: tasks sum their batches, k * (1 + d + d * d) numbers a part are all that is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {part: np.zeros(m.shape[0] * (1 + m.shape[1] + m.shape[1] ** 2)) for part, m in means.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows = batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for part, m in means.items():
                x = rows[own == part]
                if len(x):
                    w = _soft(x, m)
                    total[part] += np.concatenate([w.sum(0), (w.T @ x).ravel(), np.einsum("nk,ni,nj->kij", w, x, x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["part", "s"])

    sums = data.select("part", "x").mapInArrow(run, "part int, s array<double>").select("part", F.posexplode("s").alias("i", "v")).groupBy("part", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for part, m in means.items():
        k, d = m.shape
        flat = np.array([v for _, v in sorted((r["i"], r["v"]) for r in sums if r["part"] == part)] or np.zeros(k * (1 + d + d * d)))
        n, s, p = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d, d)
        safe = np.maximum(n, 1e-300)
        new = np.where(n[:, None] > 0, s / safe[:, None], m)  # a cluster without points stays
        out[part] = Clusters(n, new, p / safe[:, None, None] - new[:, :, None] * new[:, None, :] * (n > 0)[:, None, None])
    return out


def _settled(data: DataFrame, means: dict[int, np.ndarray], rounds: int) -> dict[int, Clusters]:
    """Rounds of soft clustering until no mean moves, and the clusters by the last means."""
    for _ in range(rounds):
        found = _cluster(data, means)
        still = all(np.allclose(c.means, means[part], atol=1e-9) for part, c in found.items())
        means = {part: c.means for part, c in found.items()}
        if still:
            break
    last = _cluster(data, means)
    return {part: Clusters(c.weights, means[part], c.covariances) for part, c in last.items()}


def _order(seed: int) -> Column:
    return F.xxhash64(F.concat_ws("|", "chrom", F.col("bin").cast("string"), F.lit(str(seed))))


def _points(data: DataFrame, n: int, seed: int) -> np.ndarray:
    """The points of the smallest hashes of chrom, bin and seed."""
    return np.array([r["x"] for r in data.select("x", _order(seed).alias("h")).orderBy("h").limit(n).collect()], float)


def soft_clusters(data: DataFrame, k: int, rounds: int = 10, seed: int = 1) -> tuple[list[list[float]], list[list[list[float]]], list[float]]:
    """Means, covariances and weights of k soft clusters, ordered by the norm of the mean.

    The first means are the points of the smallest hashes of chrom, bin and seed.
    """
    one = data.select(F.lit(0).alias("part"), F.col("x").cast("array<double>").alias("x"))
    found = _settled(one, {0: _points(data, k, seed)}, rounds)[0].ordered()
    return found.means.tolist(), found.covariances.tolist(), (found.weights / found.weights.sum()).tolist()


#: Points to choose first means among, for each channel; and the distance of two means, in deviations along the line between them, from which clusters are two.
FIRST_POINTS, APART = 64, 3.5


def _spread(points: np.ndarray, k: int) -> np.ndarray:
    """k of the points: the first, then always the one farthest from those chosen; fewer if the points are fewer."""
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def _distances(a: Clusters, b: Clusters) -> np.ndarray:
    """Distances of all means of a and b, in pooled deviations along the line between the two."""
    line = a.means[:, None] - b.means
    length = np.sqrt((line**2).sum(2))
    unit = line / np.maximum(length, 1e-300)[:, :, None]
    along = [np.maximum(np.einsum(f"abi,{axis}ij,abj->ab", unit, c.covariances, unit), 0) for axis, c in (("a", a), ("b", b))]
    n = a.weights[:, None] + b.weights
    pooled = np.sqrt((a.weights[:, None] * along[0] + b.weights * along[1]) / np.maximum(n, 1e-300))
    return length / np.maximum(pooled, 1e-12 * np.maximum(length, 1e-300))


def _merged(c: Clusters, apart: float) -> np.ndarray:
    """The means with all disjoint pairs that are closer than ``apart`` merged, the closest first; clusters without points go."""
    kept = c.weights > 1e-9 * c.weights.sum()
    c = Clusters(c.weights[kept], c.means[kept], c.covariances[kept])
    d = _distances(c, c)
    d[np.tril_indices(len(d))] = np.inf
    out, gone = [], set()
    for at in np.argsort(d, axis=None, kind="stable"):
        i, j = divmod(int(at), len(d))
        if d[i, j] >= apart:
            break
        if i not in gone and j not in gone:
            gone |= {i, j}
            out.append((c.weights[i] * c.means[i] + c.weights[j] * c.means[j]) / (c.weights[i] + c.weights[j]))
    return np.array([m for i, m in enumerate(c.means) if i not in gone] + out)


def select_states(data: DataFrame, most: int | None = None, rounds: int = 10, seed: int = 1, apart: float = APART) -> Clusters:
    """Soft clusters as many as the data (chrom, bin, x) shows, ``most`` (twice the channels) at most, ordered by the norm of the mean.

    Two halves, dealt by a hash, are clustered each for itself from ``most`` means
    that lie far apart in a bounded sample. Clusters that are closer than ``apart``
    deviations are merged and the halves clustered again, until none are. Clusters
    of the two halves that are each other's nearest, and closer than ``apart``,
    are real; those that one half has alone are pruned. The real ones' means begin the
    clustering of all data.
    """
    x = F.col("x").cast("array<double>").alias("x")
    halves = data.select(F.pmod(_order(seed + 1), F.lit(2)).cast("int").alias("part"), x)
    one = data.select("x").first()
    if one is None:
        raise ValueError("there are no points")
    sample = _points(data, FIRST_POINTS * len(one[0]), seed)
    first = _spread(sample, most or 2 * sample.shape[1])
    means = {0: first, 1: first}
    while True:
        found = _settled(halves, means, rounds)
        means = {part: _merged(c, apart) for part, c in found.items()}
        if all(len(means[part]) == len(c.means) for part, c in found.items()):
            break
    a, b = found[0], found[1]
    d = _distances(a, b)
    real = [i for i in range(len(d)) if d[:, d[i].argmin()].argmin() == i and d[i].min() < apart]
    start = np.array([(a.weights[i] * a.means[i] + b.weights[j] * b.means[j]) / (a.weights[i] + b.weights[j]) for i, j in ((i, d[i].argmin()) for i in real)])
    if not len(start):  # the halves have nothing in common
        start = (sample.mean(0))[None]
    return _settled(data.select(F.lit(0).alias("part"), x), {0: start}, rounds)[0].ordered()


def sticky_transition(k: int, seed: int = 1) -> list[list[float]]:
    """Random transitions that stay with probability one half."""
    a = np.random.default_rng(seed).random((k, k))
    np.fill_diagonal(a, 0)
    np.fill_diagonal(a, a.sum(1) if k > 1 else 1)
    return (a / a.sum(1, keepdims=True)).tolist()


@dataclass(frozen=True)
class GaussianSegmenter:
    """Principal components and a Gaussian model of them."""

    pca: Pca
    fit: Fit

    def pack(self, data: DataFrame, chunk: int = 4096) -> DataFrame:
        return pack(data.select("chrom", "bin", self.pca.transform(F.col("x")).alias("obs")), chunk=chunk)


def fit_segmenter(data: DataFrame, k: int | None = None, dims: int | None = None, rounds: int = 3, seed: int = 1, chunk: int = 4096, stop: Callable[[float], bool] | None = None) -> GaussianSegmenter:
    """PCA, soft clusters of the components as first states, Baum-Welch. Without ``k`` the data selects the number of states."""
    pca = fit_pca(data, dims)
    projected = data.select("chrom", "bin", pca.transform(F.col("x")).alias("x")).persist()
    if k is None:
        found = select_states(projected, seed=seed)
        k, means, covariances, weights = len(found.means), found.means.tolist(), found.covariances.tolist(), (found.weights / found.weights.sum()).tolist()
    else:
        means, covariances, weights = soft_clusters(projected, k, seed=seed)
    steady = [(np.asarray(c) + 1e-3 * np.eye(len(c))).tolist() for c in covariances]
    first = HmmModel(weights, sticky_transition(k, seed), E.MultivariateNormal(means, steady))
    fit = baum_welch(pack(projected.withColumnRenamed("x", "obs"), chunk=chunk), first, stop or Iterations(rounds))
    projected.unpersist()
    return GaussianSegmenter(pca, fit)
