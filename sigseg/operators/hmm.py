"""Hidden Markov models over long sequences, as a scan over chunks.

A sequence (chrom) is packed into chunks of bins. A pass has three steps:

1. map: each chunk gives its K x K transfer matrix, in (+, *) for forward and
   backward or in (max, +) for the best path;
2. the small table of matrices, one row for each chunk, gives every chunk what
   enters it from the left and from the right;
3. map: each chunk walks its own bins between these known boundaries.

So a sequence of any length spreads over all tasks, and only K x K numbers for
each chunk meet in one group. Chunks of a batch walk in lockstep in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigseg.functions import emissions as E

CHUNK = 4096


@dataclass(frozen=True)
class HmmModel:
    """Start probabilities, transitions, emission and, if the model ends, end weights by state."""

    start: list[float]
    transition: list[list[float]]
    emission: E.Emission
    end: list[float] | None = None

    @property
    def n_states(self) -> int:
        return len(self.start)

    @property
    def n_alphabet(self) -> int | None:
        """Symbols of a discrete emission."""
        return len(self.emission.table[0]) if isinstance(self.emission, E.Discrete) else None

    def __str__(self) -> str:
        rows = [f"state {i}: start {p:.6g}, to {', '.join(f'{x:.6g}' for x in row)}" for i, (p, row) in enumerate(zip(self.start, self.transition, strict=True))]
        return "\n".join([*rows, f"end: {self.end}", str(self.emission)])

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "transition": self.transition, "end": self.end, "kind": type(self.emission).__name__, "emission": asdict(self.emission)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> HmmModel:
        d = json.loads(text)
        return HmmModel(d["start"], d["transition"], getattr(E, d["kind"])(**d["emission"]), d["end"])


#: The default two-state models (closed, open).
DEFAULT_START, DEFAULT_TRANSITION, DEFAULT_END = [0.9, 0.1], [[0.99, 0.01], [0.1, 0.9]], [0.7, 0.3]
DEFAULT_TABLE = [[0.8, 0.1, 0.09, 0.01], [0.02, 0.4, 0.5, 0.08]]


def default_discrete() -> HmmModel:
    return HmmModel(DEFAULT_START, DEFAULT_TRANSITION, E.Discrete(DEFAULT_TABLE), DEFAULT_END)


def default_normal() -> HmmModel:
    return HmmModel(DEFAULT_START, DEFAULT_TRANSITION, E.Normal([0.0, 2.0], [1.0, 2.5]), DEFAULT_END)


def pack(observations: DataFrame, obs: str = "obs", chunk: int = CHUNK, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, chunk, n (bins of the sequence before it), obs: observations in order of bin, in arrays of bounded length.

    Bins are numbered from 0 without gaps within a sequence.
    """
    rows = observations.withColumn("chunk", F.expr(f"bin div {chunk}"))
    packed = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("bin", F.col(obs).alias("o")))).alias("a"))
    return packed.select(F.concat_ws("\x1f", *keys).alias("seq"), *keys, "chunk", F.col("a.bin")[0].alias("first"), F.col("a.o").alias("obs"))


def _batches(pdf: pd.DataFrame, model: HmmModel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, emission densities [rows, bins, K] and whether each begins its sequence, for rows of equal length."""
    lengths = pdf["obs"].map(len).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        obs = np.stack([np.stack(pdf["obs"].iloc[i]) for i in rows]).astype(np.float64)
        yield rows, model.emission.densities(obs), (pdf["first"].to_numpy()[rows] == 0)


def _map(packed: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return packed.mapInPandas(lambda it: (run(p) for p in it if len(p)), schema)


#: A model for all sequences, or one for each cell of a grid; the cell is the first key of ``pack``.
Models = HmmModel | dict[str, HmmModel]


def _each(pdf: pd.DataFrame, models: Models, run: Callable[[pd.DataFrame, HmmModel], pd.DataFrame]) -> pd.DataFrame:
    """``run`` on the rows of each cell with its model."""
    if isinstance(models, HmmModel):
        return run(pdf, models)
    cells = pdf["seq"].str.split("\x1f", n=1).str[0]
    return pd.concat([run(part.reset_index(drop=True), models[cell]) for cell, part in pdf.groupby(cells, sort=False)])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    high = x.max(axis, keepdims=True)
    high = np.where(np.isfinite(high), high, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - high).sum(axis)) + high.squeeze(axis)


def _transfers(packed: DataFrame, models: Models, semiring: str) -> DataFrame:
    """seq, chunk, m (K * K numbers, scaled), scale (log), e (emission of its first bin). Semirings: sum, max, log."""

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        a, k = np.asarray(model.transition), model.n_states
        m, scale, e = [None] * len(pdf), np.zeros(len(pdf)), [None] * len(pdf)
        for rows, dens, begins in _batches(pdf, model):
            with np.errstate(divide="ignore"):
                step, b = (a, dens) if semiring == "sum" else (np.log(a), np.log(dens))
            one = np.eye(k) if semiring == "sum" else np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
            total, log = np.broadcast_to(one, (len(rows), k, k)).copy(), np.zeros(len(rows))
            for t in range(b.shape[1]):
                if semiring == "sum":
                    moved = total @ step
                    if t == 0:
                        moved[begins] = total[begins]
                    total = moved * b[:, t, None, :]
                    s = total.sum((1, 2))
                    total /= np.where(s > 0, s, 1)[:, None, None]
                    log += np.log(np.where(s > 0, s, 1))
                else:
                    both = total[:, :, :, None] + step[None, None]
                    moved = both.max(2) if semiring == "max" else _log_sum(both, 2)
                    if t == 0:
                        moved[begins] = total[begins]
                    total = moved + b[:, t, None, :]
            for i, r in enumerate(rows):
                m[r], scale[r], e[r] = total[i].ravel().tolist(), log[i], dens[i, 0].tolist()
        return pd.DataFrame({"seq": pdf["seq"], "chunk": pdf["chunk"], "m": m, "scale": scale, "e": e})

    return _map(packed, lambda pdf: _each(pdf, models, one), "seq string, chunk long, m array<double>, scale double, e array<double>")


def _boundaries(packed: DataFrame, models: Models, smoothing: str) -> DataFrame:
    """seq, chunk, alpha (what enters from the left), beta (what enters from the right, 1 at the end), and whether it is the last."""

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        k, a, start = model.n_states, np.asarray(model.transition), np.asarray(model.start)
        pdf = pdf.sort_values("chunk")
        m = [np.reshape(x, (k, k)) for x in pdf["m"]]
        e = np.stack(pdf["e"])
        alpha, beta = [start], [np.ones(k)]
        for x in m[:-1]:
            v = alpha[-1] @ x
            alpha.append(v / v.sum() if v.sum() > 0 else v)
        for i in range(len(m) - 1, 0, -1):
            v = {"full": m[i] @ beta[-1], "lag1": a @ e[i], "filter": np.ones(k)}[smoothing]
            beta.append(v / v.sum() if v.sum() > 0 else v)
        return pd.DataFrame({"seq": pdf["seq"], "chunk": pdf["chunk"], "alpha": [x.tolist() for x in alpha], "beta": [x.tolist() for x in reversed(beta)], "last": np.arange(len(m)) == len(m) - 1})

    return _transfers(packed, models, "sum").groupBy("seq").applyInPandas(lambda pdf: _each(pdf, models, one), "seq string, chunk long, alpha array<double>, beta array<double>, last boolean")


def _walk(pdf: pd.DataFrame, model: HmmModel, smoothing: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, densities, alpha, beta (both scaled), scales and begins of chunks between known boundaries."""
    a = np.asarray(model.transition)
    for rows, dens, begins in _batches(pdf, model):
        n, length, k = dens.shape
        alpha, beta, scale = np.zeros((n, length, k)), np.ones((n, length, k)), np.zeros((n, length))
        value = np.stack([pdf["alpha"].iloc[i] for i in rows])
        for t in range(length):
            moved = value @ a
            if t == 0:
                moved[begins] = value[begins]
            value = moved * dens[:, t]
            scale[:, t] = value.sum(1)
            value = value / np.where(scale[:, t] > 0, scale[:, t], 1)[:, None]
            alpha[:, t] = value
        value = np.stack([pdf["beta"].iloc[i] for i in rows])
        beta[:, -1] = value
        if smoothing != "filter":
            for t in range(length - 2, -1, -1):
                value = (dens[:, t + 1] * (value if smoothing == "full" else 1)) @ a.T
                value = value / np.maximum(value.sum(1), 1e-300)[:, None]
                beta[:, t] = value
        yield rows, dens, alpha, beta, scale, begins


#: Chunks up to which their boundaries (some numbers each) are broadcast, so that the observations are not shuffled.
FEW_CHUNKS = 100_000


def _joined(packed: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """``packed`` with the boundaries of its chunks; ``few`` says that there are no more than FEW_CHUNKS."""
    return packed.join(F.broadcast(edges) if few else edges, ["seq", "chunk"])


def _log_boundaries(packed: DataFrame, models: Models) -> DataFrame:
    """seq, chunk, alpha and beta (logarithms of what enters on both sides), whether it is the last, and total, the sequence's log-likelihood."""

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        k, pdf = model.n_states, pdf.sort_values("chunk")
        m = [np.reshape(x, (k, k)) for x in pdf["m"]]
        with np.errstate(divide="ignore"):
            alpha, beta = [np.log(np.asarray(model.start, float))], [np.zeros(k)]
        for x in m:
            alpha.append(_log_sum(alpha[-1][:, None] + x, 0))
        for x in m[:0:-1]:
            beta.append(_log_sum(x + beta[-1][None], 1))
        total = float(_log_sum(alpha.pop()[None], 1)[0])
        return pd.DataFrame({"seq": pdf["seq"], "chunk": pdf["chunk"], "alpha": [x.tolist() for x in alpha], "beta": [x.tolist() for x in reversed(beta)], "last": np.arange(len(m)) == len(m) - 1, "total": total})

    schema = "seq string, chunk long, alpha array<double>, beta array<double>, last boolean, total double"
    return _transfers(packed, models, "log").groupBy("seq").applyInPandas(lambda pdf: _each(pdf, models, one), schema)


def _log_walk(pdf: pd.DataFrame, model: HmmModel) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, log densities, log alpha, log beta and begins of chunks between known boundaries."""
    with np.errstate(divide="ignore"):
        a = np.log(np.asarray(model.transition, float))
    for rows, dens, begins in _batches(pdf, model):
        with np.errstate(divide="ignore"):
            b = np.log(dens)
        alpha, beta = np.zeros_like(b), np.zeros_like(b)
        value = np.stack([pdf["alpha"].iloc[i] for i in rows])
        for t in range(b.shape[1]):
            moved = _log_sum(value[:, :, None] + a[None], 1)
            if t == 0:
                moved[begins] = value[begins]
            value = alpha[:, t] = moved + b[:, t]
        value = beta[:, -1] = np.stack([pdf["beta"].iloc[i] for i in rows])
        for t in range(b.shape[1] - 2, -1, -1):
            value = beta[:, t] = _log_sum(a[None] + (b[:, t + 1] + value)[:, None, :], 2)
        yield rows, b, alpha, beta, begins


def posterior_log(packed: DataFrame, model: HmmModel) -> DataFrame:
    """chrom, bin, gamma as ``posterior`` gives it, with all sums of probabilities taken in logarithms: nothing is scaled and nothing underflows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, b, alpha, beta, _ in _log_walk(pdf, model):
            n, length, _ = b.shape
            gamma = np.exp(alpha + beta - _log_sum(alpha + beta, 2)[:, :, None])
            first = pdf["first"].to_numpy()[rows]
            out.append(pd.DataFrame({"chrom": np.repeat(pdf["chrom"].to_numpy()[rows], length), "bin": (first[:, None] + np.arange(length)).ravel(), "gamma": list(gamma.reshape(n * length, -1))}))
        return pd.concat(out)

    return _map(_joined(packed, _log_boundaries(packed, model)), run, "chrom string, bin long, gamma array<double>")


def posterior(packed: DataFrame, model: HmmModel, smoothing: str = "full") -> DataFrame:
    """chrom, bin, gamma: the probability of each state.

    ``full`` looks at the whole sequence; ``lag1`` at the bins up to the next
    one; ``filter`` at those up to here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, _, alpha, beta, _, _ in _walk(pdf, model, smoothing):
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
            n, length, _ = gamma.shape
            first = pdf["first"].to_numpy()[rows]
            out.append(pd.DataFrame({"chrom": np.repeat(pdf["chrom"].to_numpy()[rows], length), "bin": (first[:, None] + np.arange(length)).ravel(), "gamma": list(gamma.reshape(n * length, -1))}))
        return pd.concat(out)

    return _map(_joined(packed, _boundaries(packed, model, smoothing)), run, "chrom string, bin long, gamma array<double>")


def _likelihoods(packed: DataFrame, models: Models, use_end: bool = False) -> DataFrame:
    """seq, loglik: from the transfer matrices only; no bin is looked at twice. Minus infinity where the model cannot give the sequence."""

    def one(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        k, value, total = model.n_states, np.asarray(model.start, float), 0.0
        end = np.asarray(model.end if use_end and model.end else np.ones(k))
        pdf = pdf.sort_values("chunk")
        with np.errstate(divide="ignore"):
            for m, scale in zip(pdf["m"], pdf["scale"], strict=True):
                value = value @ np.reshape(m, (k, k))
                s = value.sum()
                value, total = value / (s if s > 0 else 1), total + np.log(s) + scale
            return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "loglik": [total + np.log(value @ end)]})

    return _transfers(packed, models, "sum").groupBy("seq").applyInPandas(lambda pdf: _each(pdf, models, one), "seq string, loglik double")


def log_likelihood(packed: DataFrame, model: HmmModel, use_end: bool = False) -> DataFrame:
    """chrom, loglik of each sequence."""
    return _likelihoods(packed, model, use_end).withColumnRenamed("seq", "chrom")


def log_likelihood_cells(packed: DataFrame, models: dict[str, HmmModel]) -> DataFrame:
    """cell, loglik: all sequences of a cell under its model, in one job. The cell is the first key of ``pack``."""
    return _likelihoods(packed, models).groupBy(F.substring_index("seq", "\x1f", 1).alias("cell")).agg(F.sum("loglik").alias("loglik"))


def _decode(packed: DataFrame, models: Models, use_end: bool, give: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What ``give`` makes of the best paths of chunks: rows of ``packed`` (with ``before``, the state before the chunk, -1 at the begin) and their states [rows, bins]."""

    def logs(model: HmmModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            end = np.log(np.asarray(model.end, float)) if use_end and model.end else np.zeros(model.n_states)
            return np.log(np.asarray(model.start, float)), np.log(np.asarray(model.transition, float)), end

    def edges(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        (value, _, end), k = logs(model), model.n_states
        pdf, enter, came = pdf.sort_values("chunk"), [], []
        for m in pdf["m"]:
            enter.append(value)
            both = value[:, None] + np.reshape(m, (k, k))
            came.append(both.argmax(0))
            value = both.max(0)
        leave = [int((value + end).argmax())]
        for c in reversed(came):
            leave.append(int(c[leave[-1]]))
        before = leave[::-1][:-1]
        before[0] = -1
        return pd.DataFrame({"seq": pdf["seq"], "chunk": pdf["chunk"], "enter": [x.tolist() for x in enter], "leave": leave[-2::-1], "before": before})

    def walk(pdf: pd.DataFrame, model: HmmModel) -> pd.DataFrame:
        _, a, _ = logs(model)
        out = []
        for rows, dens, begins in _batches(pdf, model):
            with np.errstate(divide="ignore"):
                b = np.log(dens)
            n, length, k = b.shape
            value = np.stack([pdf["enter"].iloc[i] for i in rows])
            back = np.zeros((length, n, k), np.int16)
            for t in range(length):
                both = value[:, :, None] + a[None]
                back[t] = both.argmax(1)
                moved = both.max(1)
                if t == 0:
                    moved[begins] = value[begins]
                value = moved + b[:, t]
            state = np.zeros((n, length), np.int32)
            at = pdf["leave"].to_numpy()[rows].astype(np.int64)
            for t in range(length - 1, -1, -1):
                state[:, t] = at
                at = back[t][np.arange(n), at]
            out.append(give(pdf.iloc[rows], state))
        return pd.concat(out)

    found = _transfers(packed, models, "max").groupBy("seq").applyInPandas(lambda pdf: _each(pdf, models, edges), "seq string, chunk long, enter array<double>, leave int, before int")
    return _map(_joined(packed, found), lambda pdf: _each(pdf, models, walk), schema)


def _key_fields(packed: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {packed.schema[k].dataType.simpleString()}" for k in keys)


def viterbi(packed: DataFrame, model: Models, use_end: bool = True, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, bin, state (from 0): the best path; of equal ones, that of the lowest states. End weights count if the model has them.

    With a model for each cell, all cells are decoded in one job; ``keys`` are those of ``pack``.
    """

    def bins(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        n, length = state.shape
        named = {k: np.repeat(rows[k].to_numpy(), length) for k in keys}
        return pd.DataFrame({**named, "bin": (rows["first"].to_numpy()[:, None] + np.arange(length)).ravel(), "state": state.ravel()})

    return _decode(packed, model, use_end, bins, f"{_key_fields(packed, keys)}, bin long, state int")


def viterbi_runs(packed: DataFrame, model: Models, use_end: bool = True, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, region, start, length, state: the runs of the best path, as ``signal.runs`` gives them of ``viterbi``.

    A chunk's walk returns a row for each run in it and knows the state before
    it, so no bin leaves the walk; only these pieces are sorted by sequence,
    to number them and to put together what chunks have cut.
    """

    def pieces(rows: pd.DataFrame, state: np.ndarray) -> pd.DataFrame:
        n, length = state.shape
        new = np.ones((n, length), bool)
        new[:, 1:] = state[:, 1:] != state[:, :-1]
        at = np.flatnonzero(new.ravel())
        row, place = at // length, at % length
        start = rows["first"].to_numpy()[row] + place
        opens = (place > 0) | (state[:, 0] != rows["before"].to_numpy())[row]
        return pd.DataFrame({**{k: rows[k].to_numpy()[row] for k in keys}, "start": start, "length": np.diff(np.append(at, n * length)), "state": state.ravel()[at], "opens": opens})

    cut = _decode(packed, model, use_end, pieces, f"{_key_fields(packed, keys)}, start long, length long, state int, opens boolean")
    numbered = cut.withColumn("region", (F.sum(F.col("opens").cast("int")).over(Window.partitionBy(*keys).orderBy("start")) - 1).cast("int"))
    return numbered.groupBy(*keys, "region").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("state").alias("state"))


def fold_log_likelihood(packed: DataFrame, model: HmmModel) -> DataFrame:
    """The same as ``log_likelihood`` by a fold over the array of a sequence of one chunk, in Spark's own expressions."""
    k = model.n_states
    emit = lambda o: model.emission.columns(o)

    def step(acc, o):
        a, e = acc["a"], emit(o)
        moved = [sum((a[i] * F.lit(model.transition[i][j]) for i in range(1, k)), a[0] * F.lit(model.transition[0][j])) for j in range(k)]
        raw = [F.when(acc["t"] == 0, a[j]).otherwise(moved[j]) * e[j] for j in range(k)]
        s = sum(raw[1:], raw[0])
        return F.struct(F.array(*[r / s for r in raw]).alias("a"), (acc["l"] + F.log(s)).alias("l"), (acc["t"] + 1).alias("t"))

    zero = F.struct(F.array(*map(F.lit, model.start)).alias("a"), F.lit(0.0).alias("l"), F.lit(0).alias("t"))
    return packed.select("chrom", F.aggregate("obs", zero, step)["l"].alias("loglik"))
