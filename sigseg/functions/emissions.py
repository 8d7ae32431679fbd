"""Emission densities, as Columns and, for the recursions, on whole numpy arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least density of a continuous emission, and of a product of categoricals.
FLOOR = 2.220446049250313e-16


def _normal_column(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-F.pow(x - mean, 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


@dataclass(frozen=True)
class Discrete:
    """table[state][symbol]; no floor."""

    table: list[list[float]]

    def columns(self, x: Column) -> list[Column]:
        return [F.element_at(F.array(*map(F.lit, row)), x.cast("int") + 1) for row in self.table]

    def densities(self, obs: np.ndarray) -> np.ndarray:
        return np.asarray(self.table).T[obs.astype(np.int64)]


@dataclass(frozen=True)
class Normal:
    """Mean and standard deviation of each state."""

    means: list[float]
    deviations: list[float]

    def columns(self, x: Column) -> list[Column]:
        return [F.greatest(_normal_column(x, m, s), F.lit(FLOOR)) for m, s in zip(self.means, self.deviations, strict=True)]

    def densities(self, obs: np.ndarray) -> np.ndarray:
        m, s = np.asarray(self.means), np.asarray(self.deviations)
        return np.maximum(np.exp(-((obs[..., None] - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)), FLOOR)


@dataclass(frozen=True)
class Mixture:
    """Weights, means and deviations of each state's components."""

    weights: list[list[float]]
    means: list[list[float]]
    deviations: list[list[float]]

    def __post_init__(self) -> None:
        if any(abs(sum(w) - 1) > 1e-6 for w in self.weights):
            raise ValueError("the weights of a state must sum to 1")

    def columns(self, x: Column) -> list[Column]:
        parts = zip(self.weights, self.means, self.deviations, strict=True)
        return [F.greatest(reduce(lambda a, b: a + b, [_normal_column(x, mi, si) * wi for wi, mi, si in zip(w, m, s, strict=True)]), F.lit(FLOOR)) for w, m, s in parts]

    def components(self, obs: np.ndarray) -> np.ndarray:
        w, m, s = map(np.asarray, (self.weights, self.means, self.deviations))
        return w * np.exp(-((obs[..., None, None] - m) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))

    def densities(self, obs: np.ndarray) -> np.ndarray:
        return np.maximum(self.components(obs).sum(-1), FLOOR)


@dataclass(frozen=True)
class Multinomial:
    """table[state][feature][symbol]: independent categoricals; observations are arrays of symbols."""

    table: list[list[list[float]]]

    def columns(self, x: Column) -> list[Column]:
        out = []
        for features in self.table:
            parts = [F.element_at(F.array(*map(F.lit, row)), F.element_at(x, i + 1).cast("int") + 1) for i, row in enumerate(features)]
            out.append(F.greatest(reduce(lambda a, b: a * b, parts), F.lit(FLOOR)))
        return out

    def densities(self, obs: np.ndarray) -> np.ndarray:
        table, symbols = np.asarray(self.table), obs.astype(np.int64)
        picked = [table[:, f, :].T[symbols[..., f]] for f in range(table.shape[1])]
        return np.maximum(np.prod(picked, axis=0), FLOOR)


#: Fixed value: eigenvalues of a covariance below it count as none.
EIGEN_CUT = 1e-5


def _spectrum(covariance: list[list[float]]) -> tuple[np.ndarray, float]:
    """Pseudo-inverse of a covariance, and the logarithm of its norming constant over the axes that it has."""
    values, vectors = np.linalg.eigh(np.asarray(covariance, float))
    kept = values > EIGEN_CUT
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
    return inverse, -0.5 * float(kept.sum() * math.log(2 * math.pi) + np.log(values[kept]).sum())


def _mvn_column(x: Column, mean: list[float], covariance: list[list[float]]) -> Column:
    inverse, norm = _spectrum(covariance)
    d = [F.element_at(x, i + 1) - m for i, m in enumerate(mean)]
    form = reduce(lambda a, b: a + b, [d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))])
    return F.exp(F.lit(norm) - form / 2)


def _mvn_log(obs: np.ndarray, mean: list[float], covariance: list[list[float]]) -> np.ndarray:
    inverse, norm = _spectrum(covariance)
    d = obs - np.asarray(mean)
    return norm - np.einsum("...i,ij,...j->...", d, inverse, d) / 2


@dataclass(frozen=True)
class MultivariateNormal:
    """Mean vector and covariance matrix of each state; observations are vectors. A singular covariance counts the axes that it has."""

    means: list[list[float]]
    covariances: list[list[list[float]]] = field(repr=False)

    def columns(self, x: Column) -> list[Column]:
        return [F.greatest(_mvn_column(x, m, c), F.lit(FLOOR)) for m, c in zip(self.means, self.covariances, strict=True)]

    def log_densities(self, obs: np.ndarray) -> np.ndarray:
        return np.stack([_mvn_log(obs, m, c) for m, c in zip(self.means, self.covariances, strict=True)], -1)

    def densities(self, obs: np.ndarray) -> np.ndarray:
        return np.maximum(np.exp(self.log_densities(obs)), FLOOR)


@dataclass(frozen=True)
class MultivariateMixture:
    """weights[state][component], and a mean vector and a covariance of each component."""

    weights: list[list[float]]
    means: list[list[list[float]]]
    covariances: list[list[list[list[float]]]] = field(repr=False)

    def columns(self, x: Column) -> list[Column]:
        parts = zip(self.weights, self.means, self.covariances, strict=True)
        return [F.greatest(reduce(lambda a, b: a + b, [_mvn_column(x, mi, ci) * wi for wi, mi, ci in zip(w, m, c, strict=True)]), F.lit(FLOOR)) for w, m, c in parts]

    def components(self, obs: np.ndarray) -> np.ndarray:
        """Weighted densities [..., state, component]."""
        parts = zip(self.weights, self.means, self.covariances, strict=True)
        return np.stack([np.stack([wi * np.exp(_mvn_log(obs, mi, ci)) for wi, mi, ci in zip(w, m, c, strict=True)], -1) for w, m, c in parts], -2)

    def densities(self, obs: np.ndarray) -> np.ndarray:
        return np.maximum(self.components(obs).sum(-1), FLOOR)


Emission = Discrete | Normal | Mixture | Multinomial | MultivariateNormal | MultivariateMixture
