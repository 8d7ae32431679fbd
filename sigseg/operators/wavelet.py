"""Wavelet pyramid of a signal and hidden Markov trees over it.

Pyramids and trees are walked by bands of TIER levels whose subtrees are groups of
bounded size, so 2**24 leaves take two rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.operators.signal import to_grid
from sigseg.sources.folders import scratch_folder

#: Low- and high-pass filters of two taps: mean and half difference.
MEAN = ([0.5, 0.5], [-0.5, 0.5])
HAAR = ([1 / math.sqrt(2)] * 2, [-1 / math.sqrt(2), 1 / math.sqrt(2)])
#: Four taps, orthogonal, that keep constants and slopes apart from details.
_R3 = math.sqrt(3)
FOUR = ([x / (4 * math.sqrt(2)) for x in (1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3)], [x / (4 * math.sqrt(2)) for x in (1 - _R3, _R3 - 3, 3 + _R3, -1 - _R3)])
#: Least standard deviation of a state of a tree.
MIN_DEVIATION = 0.1
#: Levels of a tree that are walked in one group.
TIER = 12


def padded(signal: DataFrame) -> tuple[DataFrame, int]:
    """``signal`` with zeros up to a power of two, and its exponent: the largest over the chromosomes, so that all trees have one depth."""
    top = signal.agg(F.max("bin")).first()[0]
    depth = 0 if top is None else int(top).bit_length()
    sizes = signal.select("chrom").distinct().withColumn("bins", F.lit(1 << depth).cast("long"))
    return to_grid(signal.select("chrom", "bin", F.col("value").cast("double").alias("value")), sizes), depth


def dwt(signal: DataFrame, filters: tuple[list[float], list[float]] = MEAN, levels: int | None = None) -> DataFrame:
    """chrom, level (1 is the finest), idx, approx, detail.

    Two taps go by bands of TIER levels: a band's subtrees are groups of at
    most 2**TIER nodes, and one aggregate gives the next band its input.
    Filters of more taps wrap around and take a shuffle for each level.
    """
    full, depth = padded(signal)
    at, most = full.select("chrom", F.col("bin").alias("idx"), F.col("value").alias("approx")), depth if levels is None else min(levels, depth)
    if len(filters[0]) > 2:
        return _dwt_wide(at, filters, depth, most)
    low, high = np.asarray(filters[0]), np.asarray(filters[1])
    out = []
    for first in range(0, most, TIER):
        n = min(TIER, most - first)
        out.append(at.groupBy("chrom", F.expr(f"shiftright(idx, {n})").alias("root")).applyInPandas(_band_down(low, high, first, n), PYRAMID))
        ones = F.bit_count(F.col("idx").bitwiseAND(F.lit((1 << n) - 1)))
        share = F.pow(F.lit(float(low[1])), ones) * F.pow(F.lit(float(low[0])), n - ones)
        at = at.groupBy("chrom", F.expr(f"shiftright(idx, {n})").alias("idx")).agg(F.sum(F.col("approx") * share).alias("approx"))
    return reduce(DataFrame.unionByName, out) if out else full.sparkSession.createDataFrame([], PYRAMID)


PYRAMID = "chrom string, level int, idx long, approx double, detail double"


def _band_down(low: np.ndarray, high: np.ndarray, first: int, n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All levels from ``first`` + 1 on of one subtree whose leaves are the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        value, root, out = pdf["approx"].to_numpy(float), int(pdf["idx"].iloc[0]) >> n, []
        for j in range(1, n + 1):
            pairs = value.reshape(-1, 2)
            value = pairs @ low
            idx = (root << (n - j)) + np.arange(len(value))
            out.append(pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "level": first + j, "idx": idx, "approx": value, "detail": pairs @ high}))
        return pd.concat(out)

    return run


def _dwt_wide(at: DataFrame, filters: tuple[list[float], list[float]], depth: int, most: int) -> DataFrame:
    """Each level is written before the next one reads it, so that no level is computed again for those above."""
    low, high = filters
    out, spark = [], at.sparkSession
    folder = scratch_folder(spark, "pyramid")
    taps = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(low[t]).alias("l"), F.lit(high[t]).alias("h")) for t in range(len(low))]))
    for level in range(1, most + 1):
        rows = at.select("chrom", "idx", "approx", taps.alias("x")).filter((F.col("idx") - F.col("x.t")) % 2 == 0)
        to = F.pmod(((F.col("idx") - F.col("x.t")) / 2).cast("long"), F.lit(1 << (depth - level)))
        rows = rows.select("chrom", to.alias("idx"), (F.col("approx") * F.col("x.l")).alias("a"), (F.col("approx") * F.col("x.h")).alias("d"))
        rows.groupBy("chrom", "idx").agg(F.sum("a").alias("approx"), F.sum("d").alias("detail")).write.parquet(f"{folder}/{level}")
        at = spark.read.schema("chrom string, idx long, approx double, detail double").parquet(f"{folder}/{level}")
        out.append(at.select("chrom", F.lit(level).alias("level"), "idx", "approx", "detail"))
    return reduce(DataFrame.unionByName, out) if out else at.sparkSession.createDataFrame([], PYRAMID)


def idwt(pyramid: DataFrame, filters: tuple[list[float], list[float]] = MEAN) -> DataFrame:
    """chrom, bin, value from the coarsest approximation and all details of a pyramid.

    Two taps go from the top by bands of TIER levels. More taps must be an
    orthogonal pair; they wrap around, and take a shuffle for each level.
    """
    if len(filters[0]) > 2:
        return _idwt_wide(pyramid, filters)
    top = pyramid.agg(F.max("level")).first()[0]
    if top is None:
        return pyramid.select("chrom", F.col("idx").alias("bin"), F.col("approx").alias("value"))
    at = pyramid.filter(F.col("level") == top).select("chrom", "idx", "approx")
    for low in range((top - 1) // TIER * TIER + 1, 0, -TIER):
        high = min(low + TIER - 1, top)
        roots = at.select("chrom", F.lit(high + 1).alias("level"), "idx", F.col("approx").alias("x"), F.col("idx").alias("root"))
        details = pyramid.filter(F.col("level").between(low, high)).select("chrom", "level", "idx", F.col("detail").alias("x"), F.expr(f"shiftright(idx, cast({high} - level as int))").alias("root"))
        at = roots.unionByName(details).groupBy("chrom", "root").applyInPandas(_band_up(filters, low, high), "chrom string, idx long, approx double")
    return at.select("chrom", F.col("idx").alias("bin"), F.col("approx").alias("value"))


def orthogonal_scale(filters: tuple[list[float], list[float]]) -> float:
    """What the pair's synthesis multiplies a signal by; an error if shifts of the pair by two are not orthogonal or unlike in length."""
    low, high = (np.asarray(f, float) for f in filters)
    scale = float(low @ low)
    pairs = [(x, y, s) for x, y in ((low, low), (high, high), (low, high)) for s in range(0, len(low), 2)]
    pairs += [(high, low, s) for s in range(2, len(low), 2)]
    for x, y, s in pairs:
        if abs(x[: len(x) - s] @ y[s:] - (scale if s == 0 and x is y else 0)) > 1e-9 * scale:
            raise ValueError("the filters are not an orthogonal pair")
    return scale


def _idwt_wide(pyramid: DataFrame, filters: tuple[list[float], list[float]]) -> DataFrame:
    scale, (low, high) = orthogonal_scale(filters), filters
    ends = pyramid.agg(F.max("level"), F.min("level"), F.max(F.when(F.col("level") == 1, F.col("idx")))).first()
    if ends[0] is None:
        return pyramid.select("chrom", F.col("idx").alias("bin"), F.col("approx").alias("value"))
    top, depth = ends[0], int(ends[2] + 1).bit_length()
    taps = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(low[t] / scale).alias("l"), F.lit(high[t] / scale).alias("h")) for t in range(len(low))]))
    at = pyramid.filter(F.col("level") == top).select("chrom", "idx", "approx")
    for level in range(top, 0, -1):
        details = pyramid.filter(F.col("level") == level).select("chrom", "idx", F.lit(0.0).alias("approx"), "detail")
        both = at.withColumn("detail", F.lit(0.0)).unionByName(details).select("chrom", "idx", "approx", "detail", taps.alias("x"))
        to = F.pmod(2 * F.col("idx") + F.col("x.t"), F.lit(1 << (depth - level + 1)))
        rows = both.select("chrom", to.alias("idx"), (F.col("approx") * F.col("x.l") + F.col("detail") * F.col("x.h")).alias("v"))
        at = rows.groupBy("chrom", "idx").agg(F.sum("v").alias("approx"))
    return at.select("chrom", F.col("idx").alias("bin"), F.col("approx").alias("value"))


def _band_up(filters: tuple[list[float], list[float]], low: int, high: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The approximations below one subtree, from that of its root (at level ``high`` + 1) and all its details."""
    (l0, l1), (h0, h1) = filters
    scale = l0 * h1 - l1 * h0  # the two-tap step is inverted exactly, whatever its scale

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = {int(k): rows["x"].to_numpy(float) for k, rows in pdf.sort_values(["level", "idx"]).groupby("level")}
        value, root = levels[high + 1], int(pdf["root"].iloc[0])
        for level in range(high, low - 1, -1):
            d = levels[level]
            value = np.stack([(value * h1 - d * l1) / scale, (d * l0 - value * h0) / scale], 1).ravel()
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "idx": (root << (high - low + 1)) + np.arange(len(value)), "approx": value})

    return run


@dataclass(frozen=True)
class TreeModel:
    """Root probabilities, transitions from parent to child, and a normal emission of each state.

    ``levels`` gives a level means and deviations of its own; all others have the common ones.
    """

    root: list[float]
    transition: list[list[float]]
    means: list[float]
    deviations: list[float]
    levels: dict[int, tuple[list[float], list[float]]] | None = None

    def level_emission(self, level: int) -> tuple[list[float], list[float]]:
        return (self.levels or {}).get(level, (self.means, self.deviations))


@dataclass(frozen=True)
class _Passes:
    """Messages of a tree in logs: sums of children, or their best, for each state of the parent."""

    model: TreeModel
    best: bool

    def densities(self, x: np.ndarray, level: int) -> np.ndarray:
        m, s = map(np.asarray, self.model.level_emission(level))
        return np.maximum(-((x[:, None] - m) ** 2) / (2 * s * s) - np.log(s * math.sqrt(2 * math.pi)), math.log(1e-300))

    def to_parent(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            both = v[:, None, :] + np.log(np.maximum(self.model.transition, 1e-300))[None]
        if self.best:
            return both.max(2)
        high = both.max(2)
        return high + np.log(np.exp(both - high[:, :, None]).sum(2))

    def up(self, pdf: pd.DataFrame, low: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each level of a subtree, idx and the log messages that its nodes have gathered."""
        k, out, said = len(self.model.root), {}, None
        for level, rows in pdf.sort_values(["level", "idx"]).groupby("level"):
            v = self.densities(rows["x"].to_numpy(float), int(level))
            if level == low:
                v = v + np.array([np.zeros(k) if x is None else x for x in rows["said"]])
            else:
                v = v + said.reshape(-1, 2, k).sum(1)
            out[int(level)] = rows["idx"].to_numpy(), v
            said = self.to_parent(v)
        return out


def _tiers(tree: DataFrame, value: str) -> tuple[list[tuple[int, int]], DataFrame]:
    """Bands of at most TIER levels, from the leaves up, and the nodes with the root of their subtree in their band."""
    top = tree.agg(F.max("level")).first()[0] or 0
    bands = [(low, min(low + TIER - 1, top)) for low in range(1, top + 1, TIER)]
    ends = F.least(F.floor((F.col("level") - 1) / TIER) * TIER + TIER, F.lit(top))
    root = F.expr("shiftright(idx, cast(e - level as int))")
    return bands, tree.withColumn("e", ends).select("chrom", "level", "idx", F.col(value).alias("x"), root.alias("root"))


def _to_root(passes: _Passes, low: int, high: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        message = passes.to_parent(passes.up(pdf, low)[high][1])
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[:1].to_numpy(), "c": [int(pdf["root"].iloc[0]) >> 1], "m": [message[0].tolist()]})

    return run


def _from_root(down: Callable[[pd.DataFrame, int], pd.DataFrame], low: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return down(pdf, low)

    return run


def _walk_tree(tree: DataFrame, passes: _Passes, value: str, down: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """Up through the bands, then ``down`` on every subtree with what its parent says (``above``; null at the root)."""
    k = len(passes.model.root)
    bands, nodes = _tiers(tree, value)
    nodes = nodes.persist()
    said, held = None, []
    for low, high in bands:
        band = nodes.filter(F.col("level").between(low, high))
        if said is not None:
            lowest = F.when(F.col("level") == low, F.col("idx")).otherwise(F.lit(-1).cast("long"))
            band = band.withColumn("c", lowest).join(said, ["chrom", "c"], "left").drop("c")
        else:
            band = band.withColumn("said", F.lit(None).cast("array<double>"))
        band = band.persist()
        held.append(band)

        roots = band.groupBy("chrom", "root").applyInPandas(_to_root(passes, low, high), "chrom string, c long, m array<double>")
        said = roots.groupBy("chrom", "c").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(k)]).alias("said")).persist()
    out, above = [], None
    for (low, high), band in reversed(list(zip(bands, held, strict=True))):
        if above is None:
            band = band.withColumn("above", F.lit(None).cast("array<double>"))
        else:
            band = band.withColumn("p", F.expr("root div 2")).join(above, ["chrom", "p"], "left").drop("p")

        done = band.groupBy("chrom", "root").applyInPandas(_from_root(down, low), schema).persist()
        out.append(done)
        above = done.filter(F.col("level") == low).select("chrom", F.col("idx").alias("p"), F.col("say").alias("above"))
    return reduce(DataFrame.unionByName, out) if out else tree.sparkSession.createDataFrame([], schema)


def tree_posterior(tree: DataFrame, model: TreeModel, value: str = "detail") -> DataFrame:
    """chrom, level, idx, gamma (probability of each state), xi (of parent and state, flat; null at the root).

    ``tree``: chrom, level (1 the leaves), idx and the value of each node, all
    nodes present. Upward, a node's message is its density times its
    children's; downward, the parent's posterior weights it. Levels go by
    bands of TIER: a band's subtrees are groups of at most 2**TIER nodes.
    """
    passes = _Passes(model, False)
    a = np.asarray(model.transition)

    def down(pdf: pd.DataFrame, low: int) -> pd.DataFrame:
        levels, out, parent = passes.up(pdf, low), [], None
        above = pdf["above"].iloc[0]
        for level in sorted(levels, reverse=True):
            idx, v = levels[level]
            e = np.exp(v - v.max(1, keepdims=True))
            if parent is None and above is None:
                gamma, xi = e * np.asarray(model.root), [None] * len(idx)
                gamma /= gamma.sum(1, keepdims=True)
            else:
                g = np.asarray(above)[None] if parent is None else np.repeat(parent, 2, 0)
                pair = a[None] * e[:, None, :]
                pair = g[:, :, None] * pair / np.maximum(pair.sum(2, keepdims=True), 1e-300)
                gamma, xi = pair.sum(1), [x.ravel().tolist() for x in pair]
            parent = gamma
            out.append(pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "level": level, "idx": idx, "gamma": gamma.tolist(), "xi": xi, "say": gamma.tolist()}))
        return pd.concat(out)

    schema = "chrom string, level int, idx long, gamma array<double>, xi array<double>, say array<double>"
    return _walk_tree(tree, passes, value, down, schema).drop("say")


def tree_viterbi(tree: DataFrame, model: TreeModel, value: str = "detail") -> DataFrame:
    """chrom, level, idx, state: the most probable states of all nodes together; lower states win ties."""
    passes = _Passes(model, True)
    log_a, log_root = np.log(np.maximum(model.transition, 1e-300)), np.log(np.maximum(model.root, 1e-300))

    def down(pdf: pd.DataFrame, low: int) -> pd.DataFrame:
        levels, out, parent = passes.up(pdf, low), [], None
        above = pdf["above"].iloc[0]
        for level in sorted(levels, reverse=True):
            idx, v = levels[level]
            if parent is None and above is None:
                state = (v + log_root).argmax(1)
            else:
                p = np.full(len(idx), int(above[0])) if parent is None else np.repeat(parent, 2)
                state = (v + log_a[p]).argmax(1)
            parent = state
            out.append(pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "level": level, "idx": idx, "state": state.astype(np.int32), "say": [[float(x)] for x in state]}))
        return pd.concat(out)

    return _walk_tree(tree, passes, value, down, "chrom string, level int, idx long, state int, say array<double>").drop("say")


def tree_fit(tree: DataFrame, model: TreeModel, rounds: int, value: str = "detail") -> TreeModel:
    """EM: each round sums the posterior counts of all nodes in one aggregate."""
    k = len(model.root)
    for _ in range(rounds):
        both = tree_posterior(tree, model, value).join(tree.select("chrom", "level", "idx", F.col(value).alias("x")), ["chrom", "level", "idx"])
        g = [F.col("gamma")[i] for i in range(k)]
        aggs = [F.sum(c) for c in g] + [F.sum(c * F.col("x")) for c in g] + [F.sum(c * F.pow(F.col("x") - m, 2)) for c, m in zip(g, model.means, strict=True)]
        aggs += [F.sum(F.col("xi")[i]) for i in range(k * k)] + [F.avg(F.when(F.col("xi").isNull(), c)) for c in g]
        s = np.array(both.agg(*[c.alias(f"c{i}") for i, c in enumerate(aggs)]).first(), float)
        w, xi = s[:k], s[3 * k : 3 * k + k * k].reshape(k, k)
        model = replace(
            model,
            root=s[3 * k + k * k :].tolist(),
            transition=(xi / xi.sum(1, keepdims=True)).tolist(),
            means=(s[k : 2 * k] / w).tolist(),
            deviations=np.maximum(np.sqrt(s[2 * k : 3 * k] / w), MIN_DEVIATION).tolist(),
        )
    return model


def denoise(signal: DataFrame, model: TreeModel, keep: int = 1, filters: tuple[list[float], list[float]] = MEAN) -> DataFrame:
    """The signal with each detail weighted by the probability of state ``keep``."""
    pyramid = dwt(signal, filters)
    gamma = tree_posterior(pyramid, model).select("chrom", "level", "idx", F.col("gamma")[keep].alias("w"))
    shrunk = pyramid.join(gamma, ["chrom", "level", "idx"]).withColumn("detail", F.col("detail") * F.col("w"))
    return idwt(shrunk.select("chrom", "level", "idx", "approx", "detail"), filters)
