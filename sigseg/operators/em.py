"""Baum-Welch: each iteration is one pass of Spark over the packed chunks and a small step on the driver.

Chunks return expected counts; their sums over all chunks and sequences, K x K
numbers and the emission's, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators.hmm import FEW_CHUNKS, HmmModel, Models, _boundaries, _each, _joined, _log_boundaries, _log_walk, _map, _walk
from sigseg.sources.folders import held

#: Least standard deviation of a normal state, and least variance of a multivariate one.
MIN_DEVIATION = 0.5
MIN_VARIANCE = 0.5


class Iterations:
    """Stop after n iterations."""

    def __init__(self, n: int) -> None:
        self.n, self.likelihoods = n, []

    def __call__(self, likelihood: float) -> bool:
        self.likelihoods.append(likelihood)
        return len(self.likelihoods) >= self.n


class SmallChange:
    """Stop after three changes in a row below the threshold."""

    def __init__(self, threshold: float = 100.0, most: int = 200) -> None:
        self.threshold, self.most, self.calm, self.likelihoods = threshold, most, 0, []

    def __call__(self, likelihood: float) -> bool:
        if self.likelihoods:
            self.calm = self.calm + 1 if abs(likelihood - self.likelihoods[-1]) < self.threshold else 0
        self.likelihoods.append(likelihood)
        return self.calm >= 3 or len(self.likelihoods) >= self.most


@dataclass
class Fit:
    """The last model, and the log-likelihood before each step."""

    model: HmmModel
    likelihoods: list[float] = field(default_factory=list)


def _emission_stats(model: HmmModel, obs: np.ndarray, gamma: np.ndarray, var_center: str) -> np.ndarray:
    """Sums over one batch, flat. obs [rows, bins, ...], gamma [rows, bins, K]."""
    e, k = model.emission, model.n_states
    g = gamma.reshape(-1, k)
    if isinstance(e, E.Discrete):
        x = obs.astype(np.int64).ravel()
        return np.stack([np.bincount(x, g[:, j], len(e.table[0])) for j in range(k)]).ravel()
    if isinstance(e, E.Normal):
        x = obs.ravel()
        center = np.asarray(e.means)
        second = (g * (x[:, None] - center) ** 2).sum(0) if var_center == "old" else g.T @ x**2
        return np.concatenate([g.sum(0), g.T @ x, second])
    if isinstance(e, E.Mixture):
        parts = e.components(obs)
        share = (parts / np.maximum(parts.sum(-1, keepdims=True), E.FLOOR)).reshape(-1, k, parts.shape[-1]) * g[:, :, None]
        x = obs.ravel()[:, None, None]
        center = np.asarray(e.means)
        return np.concatenate([share.sum(0).ravel(), (share * x).sum(0).ravel(), (share * (x - center) ** 2).sum(0).ravel()])
    if isinstance(e, E.Multinomial):
        x = obs.astype(np.int64).reshape(len(g), obs.shape[-1])
        m = len(e.table[0][0])
        return np.stack([[np.bincount(x[:, f], g[:, j], m) for f in range(x.shape[1])] for j in range(k)]).ravel()
    x = obs.reshape(len(g), obs.shape[-1])
    if isinstance(e, E.MultivariateMixture):
        parts = e.components(x)
        share = parts / np.maximum(parts.sum(-1, keepdims=True), E.FLOOR) * g[:, :, None]
        d = x[:, None, None, :] - np.asarray(e.means)
        return np.concatenate([share.sum(0).ravel(), np.einsum("nkc,ni->kci", share, x).ravel(), np.einsum("nkc,nkci,nkcj->kcij", share, d, d).ravel()])
    center = np.asarray(e.means)
    d = x[:, None, :] - center
    return np.concatenate([g.sum(0), (g.T @ x).ravel(), np.einsum("nk,nki,nkj->kij", g, d, d).ravel()])


def _shares(counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Counts over their sums along the last axis; ``before`` where all are 0."""
    total = counts.sum(-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), before)


def _emission_step(model: HmmModel, s: np.ndarray, var_center: str) -> E.Emission:
    e, k = model.emission, model.n_states
    if isinstance(e, E.Discrete):
        table = s.reshape(k, -1)
        return E.Discrete(_shares(table, np.asarray(e.table)).tolist())
    if isinstance(e, E.Normal):
        w, first, second = s.reshape(3, k)
        met, safe = w > 0, np.where(w > 0, w, 1)  # a state that is never met stays as it is
        means = np.where(met, first / safe, e.means)
        variance = second / safe if var_center == "old" else second / safe - means**2
        return E.Normal(means.tolist(), np.where(met, np.maximum(np.sqrt(np.maximum(variance, 0)), MIN_DEVIATION), e.deviations).tolist())
    if isinstance(e, E.Mixture):
        w, first, second = s.reshape(3, k, -1)
        safe = np.maximum(w, 1e-300)
        return E.Mixture((w / w.sum(1, keepdims=True)).tolist(), (first / safe).tolist(), np.maximum(np.sqrt(second / safe), MIN_DEVIATION).tolist())
    if isinstance(e, E.Multinomial):
        table = s.reshape(k, len(e.table[0]), -1)
        return E.Multinomial(_shares(table, np.asarray(e.table)).tolist())
    if isinstance(e, E.MultivariateMixture):
        n, d = len(e.weights[0]), len(e.means[0][0])
        w, first, second = s[: k * n].reshape(k, n), s[k * n : k * n * (1 + d)].reshape(k, n, d), s[k * n * (1 + d) :].reshape(k, n, d, d)
        safe = np.maximum(w, 1e-300)
        covariance = second / safe[:, :, None, None]
        on = np.arange(d)
        covariance[:, :, on, on] = np.maximum(covariance[:, :, on, on], MIN_VARIANCE)
        return E.MultivariateMixture((w / w.sum(1, keepdims=True)).tolist(), (first / safe[:, :, None]).tolist(), covariance.tolist())
    d = len(e.means[0])
    w, first, second = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d, d)
    covariance = second / w[:, None, None]
    on = np.arange(d)
    covariance[:, on, on] = np.maximum(covariance[:, on, on], MIN_VARIANCE)
    return E.MultivariateNormal((first / w[:, None]).tolist(), covariance.tolist())


def with_floor(transition: np.ndarray, least: float | list[float]) -> np.ndarray:
    """Self transitions of at least ``least`` (one for all states, or one each); what they lack is taken from the others of the row alike, down to 0."""
    a, k = transition.copy(), len(transition)
    for i in range(k):
        floor = float(np.broadcast_to(least, k)[i])
        lack = floor - a[i, i]
        if lack > 0 and k > 1:
            others = np.arange(k) != i
            a[i, others] = np.maximum(a[i, others] - lack / (k - 1), 0)
            a[i, i] = 0
            a[i] *= (1 - floor) / a[i].sum() if a[i].sum() > 0 else 0
            a[i, i] = 1 - a[i].sum()
    return a


def _counted(pdf: pd.DataFrame, model: HmmModel, rows: np.ndarray, log: np.ndarray, gamma: np.ndarray, pairs: np.ndarray, begins: np.ndarray, var_center: str) -> list[tuple[str, list[float]]]:
    """seq and statistics of each chunk of a batch, from its log-likelihood, the states' and the transitions' posteriors."""
    obs = np.stack([np.stack(pdf["obs"].iloc[i]) for i in rows]).astype(np.float64)
    ends, out = pdf["last"].to_numpy()[rows], []
    pairs[begins, 0] = 0
    for i, r in enumerate(rows):
        edges = np.concatenate([[log[i], float(begins[i])], gamma[i, 0] * begins[i], gamma[i, -1] * ends[i]])
        out.append((pdf["seq"].iloc[r], np.concatenate([edges, pairs[i].sum(0).ravel(), _emission_stats(model, obs[i : i + 1], gamma[i : i + 1], var_center)]).tolist()))
    return out


def _log_statistics(packed: DataFrame, models: Models, var_center: str, few: bool) -> DataFrame:
    """What ``_statistics`` gives, with posteriors as differences of logarithms: nothing is scaled, so no state's probability is lost to underflow."""

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        out = []
        with np.errstate(divide="ignore"):
            a = np.log(np.asarray(model.transition, float))
        for rows, b, alpha, beta, begins in _log_walk(pdf, model):
            total = pdf["total"].to_numpy()[rows]
            known = np.isfinite(total)  # a sequence that the model cannot give has no counts
            less = np.where(known, total, 0)[:, None, None]
            gamma = np.exp(alpha + beta - less) * known[:, None, None]
            enter = np.stack([pdf["alpha"].iloc[i] for i in rows])[:, None, :]
            before = np.concatenate([enter, alpha[:, :-1]], 1)
            pairs = np.exp(before[:, :, :, None] + a + (b + beta)[:, :, None, :] - less[:, :, :, None]) * known[:, None, None, None]
            out += _counted(pdf, model, rows, np.where(begins, total, 0), gamma, pairs, begins, var_center)
        return pd.DataFrame(out, columns=["seq", "s"])

    return _map(_joined(packed, _log_boundaries(packed, models), few), lambda pdf: _each(pdf, models, one), "seq string, s array<double>")


def _statistics(packed: DataFrame, models: Models, smoothing: str, var_center: str, few: bool = False) -> DataFrame:
    """seq, s for each chunk: log-likelihood, number of sequences, counts of starts, ends and transitions, and the emission's sums. Smoothing ``log`` is the full one in logarithms."""
    if smoothing == "log":
        return _log_statistics(packed, models, var_center, few)

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        a, out = np.asarray(model.transition), []
        for rows, dens, alpha, beta, scale, begins in _walk(pdf, model, smoothing):
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
            enter = np.stack([pdf["alpha"].iloc[i] for i in rows])[:, None, :]
            before = np.concatenate([enter, alpha[:, :-1]], 1)
            ahead = dens * (beta if smoothing == "full" else 1)
            pairs = before[:, :, :, None] * a * ahead[:, :, None, :]
            pairs /= np.maximum(pairs.sum((2, 3), keepdims=True), 1e-300)
            with np.errstate(divide="ignore"):
                log = np.log(scale).sum(1)
            out += _counted(pdf, model, rows, log, gamma, pairs, begins, var_center)
        return pd.DataFrame(out, columns=["seq", "s"])

    return _map(_joined(packed, _boundaries(packed, models, smoothing), few), lambda pdf: _each(pdf, models, one), "seq string, s array<double>")


def expect(packed: DataFrame, model: HmmModel, smoothing: str = "full", var_center: str = "old", few: bool = False) -> np.ndarray:
    """Log-likelihood, number of sequences, and start, end, transition and emission counts, over all sequences with a finite likelihood."""
    size = 2 + 2 * model.n_states + model.n_states**2 + _emission_stats(model, *_empty(model), var_center).size
    rows = _statistics(packed, model, smoothing, var_center, few)
    whole = rows.groupBy("seq").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    fine = whole.filter(~F.isnan("s0") & (F.abs(F.col("s0")) < float("inf")))
    got = fine.agg(*[F.sum(f"s{i}") for i in range(size)]).first()
    if got[0] is None:
        raise ValueError("no sequence has a finite likelihood")
    return np.array(got, np.float64)


def expect_cells(packed: DataFrame, models: dict[str, HmmModel], smoothing: str = "full", var_center: str = "old", few: bool = False) -> dict[str, np.ndarray]:
    """The same for each cell of a grid, in one job. Cells without a sequence of finite likelihood are absent."""
    rows = _statistics(packed, models, smoothing, var_center, few)
    sums = rows.select("seq", F.posexplode("s").alias("i", "v")).groupBy("seq", "i").agg(F.sum("v").alias("v"))
    finite = sums.filter("i = 0").filter(~F.isnan("v") & (F.abs(F.col("v")) < float("inf"))).select("seq")
    cell = F.substring_index("seq", "\x1f", 1).alias("cell")
    got = sums.join(finite, "seq").groupBy(cell, "i").agg(F.sum("v").alias("v")).collect()  # a few numbers for each cell
    out: dict[str, dict[int, float]] = {}
    for r in got:
        out.setdefault(r["cell"], {})[r["i"]] = r["v"]
    return {c: np.array([x[i] for i in range(len(x))]) for c, x in out.items()}


def _empty(model: HmmModel) -> tuple[np.ndarray, np.ndarray]:
    e = model.emission
    wide = {E.Multinomial: lambda: len(e.table[0]), E.MultivariateNormal: lambda: len(e.means[0]), E.MultivariateMixture: lambda: len(e.means[0][0])}
    shape = (1, 0, wide[type(e)]()) if type(e) in wide else (1, 0)
    return np.zeros(shape), np.zeros((1, 0, model.n_states))


def improved(model: HmmModel, s: np.ndarray, min_alpha: float | list[float] = 0.0, constraint: Callable[[HmmModel], HmmModel] | None = None, var_center: str = "old", learn_end: bool = False) -> HmmModel:
    """The model that the counts of ``expect`` give."""
    k = model.n_states
    start, end, pairs = s[2 : 2 + k], s[2 + k : 2 + 2 * k], s[2 + 2 * k : 2 + 2 * k + k * k].reshape(k, k)
    sums = pairs.sum(1, keepdims=True)
    transition = np.where(sums > 0, pairs / np.where(sums > 0, sums, 1), np.asarray(model.transition))
    transition = with_floor(transition, min_alpha) if np.any(min_alpha) else transition
    new_end = (end / end.sum()).tolist() if learn_end else model.end
    new = HmmModel((start / start.sum()).tolist(), transition.tolist(), _emission_step(model, s[2 + 2 * k + k * k :], var_center), new_end)
    return constraint(new) if constraint else new


def baum_welch(
    packed: DataFrame,
    model: HmmModel,
    stop: Callable[[float], bool] | None = None,
    min_alpha: float | list[float] = 0.0,
    constraint: Callable[[HmmModel], HmmModel] | None = None,
    smoothing: str = "full",
    var_center: str = "old",
    learn_end: bool = False,
) -> Fit:
    """Train on all sequences at once. An interrupt keeps the model so far.

    ``learn_end`` sets the end weights to the mean posterior of the sequences' last bins; else they stay.
    ``smoothing="log"`` trains in log space.
    """
    stop, fit = stop or Iterations(3), Fit(model)
    try:
        with held(packed, "training") as packed:
            few = packed.count() <= FEW_CHUNKS
            while True:
                s = expect(packed, fit.model, smoothing, var_center, few)
                fit.likelihoods.append(float(s[0]))
                fit.model = improved(fit.model, s, min_alpha, constraint, var_center, learn_end)
                if stop(fit.likelihoods[-1]):
                    return fit
    except KeyboardInterrupt:
        return fit


def random_discrete(n_states: int, n_alphabet: int, seed: int) -> HmmModel:
    """A discrete model to begin with: rows of uniform numbers, each divided by its sum."""
    drawn = np.random.default_rng(seed)
    rows = lambda n, m: (lambda x: (x / x.sum(1, keepdims=True)).tolist())(drawn.random((n, m)))
    return HmmModel(rows(1, n_states)[0], rows(n_states, n_states), E.Discrete(rows(n_states, n_alphabet)), rows(1, n_states)[0])


def baum_welch_cells(packed: DataFrame, models: dict[str, HmmModel], rounds: int, floors: dict[str, float | list[float]] | None = None, smoothing: str = "full") -> dict[str, Fit]:
    """Train a model for each cell of a grid; a round is one job for all cells. The cell is the first key of ``pack``."""
    fits = {c: Fit(m) for c, m in models.items()}
    with held(packed, "training") as packed:
        few = packed.count() <= FEW_CHUNKS
        for _ in range(rounds):
            for cell, s in expect_cells(packed, {c: f.model for c, f in fits.items()}, smoothing, few=few).items():
                fits[cell].likelihoods.append(float(s[0]))
                fits[cell].model = improved(fits[cell].model, s, (floors or {}).get(cell, 0.0))
    return fits
