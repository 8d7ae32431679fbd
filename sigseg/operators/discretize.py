"""Symbols from signals: percentiles, histograms, fitted distributions and bit packing.

Fitting and applying are separate: fits are small rows that go into the
applying expression as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigseg.sources.folders import held

#: Thresholds compare at this many decimals, so that the last bit of a percentile decides nothing.
DECIMALS = 9
#: Rows up to which a percentile is taken in one task, and the accuracy of the approximate ones that bracket it beyond.
DIRECT = 200_000
ACCURACY = 10_000


def percentiles(values: DataFrame, column: str | Column, at: list[float]) -> list[float]:
    """Exact percentiles with linear interpolation.

    Up to DIRECT rows by Spark's exact ``percentile``, which merges all
    distinct values in one task. Beyond, each rank is bracketed by approximate
    percentiles, the rows below the bracket are counted, and the bracket is
    narrowed until few enough rows (or one value) lie inside.
    """
    rows = values.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).filter("v is not null")
    n = rows.count()
    if not n:
        return [float("nan")] * len(at)
    if n <= DIRECT:
        return list(rows.agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in at])).alias("p")).first()["p"])
    places = [p / 100 * (n - 1) for p in at]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    found = _ranked(rows, n, ranks)
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in places]


def _ranked(rows: DataFrame, n: int, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks (from 0) of n rows; all ranks share each pass, and each pass takes three values out of every bracket."""
    brackets = {r: (-math.inf, math.inf, 0, n) for r in ranks}  # bounds, rows below them, rows inside
    found: dict[int, float] = {}
    while brackets:
        aggs, v = [], F.col("v")
        for r, (low, high, below, inside) in brackets.items():
            within, q = F.when((v >= low) & (v <= high), v), (r - below) / inside
            if inside <= DIRECT:
                aggs.append(F.array(F.percentile(within, (r - below) / max(inside - 1, 1))).alias(f"r{r}"))
            else:
                aggs.append(F.percentile_approx(within, [max(q - 2 / ACCURACY, 0.0), q, min(q + 2 / ACCURACY, 1.0)], ACCURACY).alias(f"r{r}"))
        got = rows.agg(*aggs).first()
        found |= {r: got[f"r{r}"][0] for r, x in brackets.items() if x[3] <= DIRECT}
        brackets = {r: x for r, x in brackets.items() if r not in found}
        pivots = sorted({p for r in brackets for p in got[f"r{r}"]})
        if not pivots:
            break
        counts = rows.agg(*[c for i, p in enumerate(pivots) for c in (F.count_if(v < p).alias(f"b{i}"), F.count_if(v <= p).alias(f"u{i}"))]).first()
        for r, (low, high, below, inside) in list(brackets.items()):
            upto = below + inside
            for i, p in enumerate(pivots):
                less, most = counts[f"b{i}"], counts[f"u{i}"]
                if less <= r < most:
                    found[r] = p
                elif most <= r and most >= below:
                    low, below = math.nextafter(p, math.inf), most
                elif less > r and less <= upto:
                    high, upto = math.nextafter(p, -math.inf), less
            brackets[r] = (low, high, below, upto - below)
        brackets = {r: x for r, x in brackets.items() if r not in found}
    return found


def above(value: Column, thresholds: list[float]) -> Column:
    """How many thresholds the value exceeds strictly."""
    return reduce(lambda a, t: a + (F.round(value, DECIMALS) > F.lit(round(t, DECIMALS))).cast("int"), thresholds, F.lit(0))


def first_not_below(value: Column, thresholds: list[float]) -> Column:
    """Index of the first threshold that is at least the value: the number of thresholds below it."""
    return above(value, thresholds)


def histogram_thresholds(values: DataFrame, column: str, bins: int = 20, take: int = 3) -> list[float]:
    """Left edges of the most populated of ``bins`` equal bins, but for the first; ties go to the lower bin."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or low == high:
        return []
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    counts = values.groupBy(place.alias("b")).count().filter("b > 0").orderBy(F.desc("count"), "b").limit(take)
    return sorted(low + width * r["b"] for r in counts.collect())  # at most ``take`` rows


def bits_for(alphabets: list[int]) -> list[int]:
    """Bits for each feature's symbols."""
    return [max(1, math.ceil(math.log2(a))) for a in alphabets]


def alphabet_size(alphabets: list[int]) -> int:
    """Symbols of the packed alphabet."""
    return 1 << sum(bits_for(alphabets))


def pack(symbols: list[Column], alphabets: list[int]) -> Column:
    """All features in one integer, the first in the lowest bits."""
    bits = bits_for(alphabets)
    parts = [F.shiftleft(s.cast("long"), sum(bits[:i])) for i, s in enumerate(symbols)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def unpack(packed: Column, alphabets: list[int]) -> list[Column]:
    """The features of a packed integer."""
    bits = bits_for(alphabets)
    return [F.shiftright(packed, sum(bits[:i])).bitwiseAND(F.lit((1 << b) - 1)).cast("int") for i, b in enumerate(bits)]


def noise_symbol(value: Column, mean: float, bias: float, threshold: float) -> Column:
    """1 where a positive value is improbable under exponential noise with a share ``bias`` of zeros."""
    density = F.exp(-value / mean) / mean
    return ((density < threshold * (1 - bias)) & (value > 0)).cast("int")


def mixture_symbol(value: Column, means: list[float], deviations: list[float], weights: list[float]) -> Column:
    """The component of ln(1 + value) with the largest (1 - weight) * density, the first of equal ones."""
    x = F.log1p(value)
    scores = [
        (1 - w) * F.exp(-F.pow(x - m, 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) for m, s, w in zip(means, deviations, weights, strict=True)
    ]
    return (F.array_position(F.array(*scores), F.greatest(*scores)) - 1).cast("int")


def jump_threshold(values: DataFrame, column: str | Column) -> float:
    """The decile before the largest step between successive deciles; the lower of equal steps."""
    cuts = percentiles(values, column, [10.0 * i for i in range(11)])
    steps = [round(b - a, DECIMALS) for a, b in zip(cuts, cuts[1:], strict=False)]
    return cuts[max(range(len(steps)), key=lambda i: (steps[i], -i))]


def two_means(values: DataFrame, column: str | Column, rounds: int = 20) -> tuple[list[float], list[float], list[float]]:
    """Means, deviations and weights of a hard split in two, from the extremes on; one aggregate for each round."""
    c = F.col(column) if isinstance(column, str) else column
    low, high = values.agg(F.min(c), F.max(c)).first()
    deviations, weights = [0.0, 0.0], [0.5, 0.5]
    for _ in range(rounds):
        upper = F.abs(c - high) < F.abs(c - low)
        row = values.agg(F.avg(F.when(~upper, c)), F.avg(F.when(upper, c)), F.stddev_pop(F.when(~upper, c)), F.stddev_pop(F.when(upper, c)), F.avg(upper.cast("double"))).first()
        new = (row[0] if row[0] is not None else low, row[1] if row[1] is not None else high)
        deviations, weights = [row[2] or 0.0, row[3] or 0.0], [1 - row[4], row[4]]
        if new == (low, high):
            break
        low, high = new
    return [low, high], deviations, weights


def _poisson_cdf(x: float, mean: float) -> float:
    if x < 0 or mean <= 0:
        return float(x >= 0)
    steps = np.arange(1, math.floor(x) + 1)
    return float(np.exp(np.append(-mean, np.cumsum(math.log(mean) - np.log(steps)) - mean)).sum())


def _normal_cdf(x: float, mean: float, deviation: float) -> float:
    return 0.5 * (1 + math.erf((x - mean) / (deviation * math.sqrt(2)))) if deviation > 0 else float(x >= mean)


KINDS = ("poisson_zero", "exponential_zero", "poisson", "exponential", "gaussian_2", "gaussian_2_zero")


@dataclass(frozen=True)
class Alphabet:
    """A fitted binary alphabet: the kind of distribution and what it needs to judge a value."""

    kind: str
    mean: float = 0.0
    bias: float = 0.0
    means: tuple[float, ...] = ()
    deviations: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    threshold: float = 0.0

    def symbol(self, value: Column) -> Column:
        """1 where the value stands out: improbable as noise, of the upper component, or beyond the largest jump."""
        if self.kind.startswith("exponential"):
            return noise_symbol(value, self.mean, self.bias, self.threshold)
        if self.kind.startswith("poisson"):
            return poisson_symbol(value, self.mean, self.bias, self.threshold)
        if self.kind.startswith("gaussian"):
            upper = mixture_symbol(value, list(self.means), list(self.deviations), list(self.weights))
            return F.when(value > 0, upper).otherwise(0) if self.kind.endswith("zero") else upper
        return above(value, [self.threshold])


def poisson_symbol(value: Column, mean: float, bias: float, threshold: float) -> Column:
    """1 where a positive value (its whole part) is improbable under Poisson noise with a share ``bias`` of zeros.

    The probability has one peak, so it is below the limit outside one range, which is found here.
    """
    limit, peak = threshold * (1 - bias), math.floor(mean)
    log = lambda k: k * math.log(mean) - mean - math.lgamma(k + 1)
    if limit <= 0 or mean <= 0 or log(peak) < math.log(limit):
        return ((value > 0) & F.lit(limit > 0)).cast("int")
    low, high = 0, 1
    while low < peak and log(low) < math.log(limit):
        low += 1
    while log(peak + high) >= math.log(limit):
        high += 1
    whole = F.floor(value)
    return (((whole < low) | (whole >= peak + high)) & (value > 0)).cast("int")


def fits(values: DataFrame, column: str, threshold: float = 0.002, kinds: tuple[str, ...] = KINDS) -> dict[str, Alphabet]:
    """Each of the hypotheses fitted; those of non-zero values and of a share of zeros are fitted to the positive values."""
    c = F.col(column)
    row = values.agg(F.avg(F.when(c > 0, c)), F.avg((c == 0).cast("double"))).first()
    positive, zeros = (x or 0.0 for x in row)
    out = {}
    for kind in kinds:
        bias = zeros if kind.endswith("zero") else 0.0
        if kind.startswith("gaussian"):
            means, deviations, weights = two_means(values.filter(c > 0) if kind.endswith("zero") else values, F.log1p(c))
            out[kind] = Alphabet(kind, 0.0, bias, tuple(means), tuple(max(x, 1e-6) for x in deviations), tuple(weights))
        else:
            out[kind] = Alphabet(kind, positive, bias, threshold=threshold)
    return out


def _cdf(a: Alphabet, x: float) -> float:
    if a.kind.startswith("exponential"):
        base = 1 - math.exp(-x / a.mean) if a.mean else 1.0
    elif a.kind.startswith("poisson"):
        base = _poisson_cdf(x, a.mean)
    else:
        base = sum(wi * _normal_cdf(math.log1p(x), mi, si) for mi, si, wi in zip(a.means, a.deviations, a.weights, strict=True))
    return a.bias + (1 - a.bias) * base


def ks_distances(values: DataFrame, column: str, fitted: dict[str, Alphabet] | None = None) -> dict[str, float]:
    """Largest distance between the distribution function of the values, at steps of 0.1 %, and each hypothesis.

    Those without a share of zeros are held against the positive values.
    """
    fitted, out = fitted or fits(values, column), {}
    steps = [i / 10 for i in range(1, 1000)]
    for some, rows in ((False, values), (True, values.filter(F.col(column) > 0))):
        mine = [a for k, a in fitted.items() if some == (k in ("poisson", "exponential"))]
        cuts = percentiles(rows, F.col(column), steps)
        for a in mine:
            out[a.kind] = max((abs(_cdf(a, x) - p / 100) for x, p in zip(cuts, steps, strict=True) if not math.isnan(x)), default=1.0)
    return out


def nearest(distances: dict[str, float], fallback: float = 0.15) -> str:
    """The hypothesis with the least distance; ``empirical`` if none is nearer than ``fallback``."""
    best = min(distances, key=lambda k: (distances[k], k))
    return best if distances[best] < fallback else "empirical"


def select_distribution(values: DataFrame, column: str, fallback: float = 0.15) -> str:
    """The hypothesis that is nearest to the values."""
    return nearest(ks_distances(values, column), fallback)


def fit_alphabet(values: DataFrame, column: str, fallback: float = 0.15, threshold: float = 0.002) -> Alphabet:
    """The alphabet of the nearest distribution, or of the largest jump."""
    fitted = fits(values, column, threshold)
    best = nearest(ks_distances(values, column, fitted), fallback)
    return fitted[best] if best != "empirical" else Alphabet("empirical", threshold=jump_threshold(values, column))


def fit_features(values: DataFrame, columns: list[str], at: list[float]) -> list[list[float]]:
    """Percentile thresholds of each feature of its own."""
    return [percentiles(values, c, at) for c in columns]


def fit_alphabets(values: DataFrame, columns: list[str], fallback: float = 0.15) -> list[Alphabet]:
    """An alphabet for each feature; ``symbol`` of each gives its binary symbols, ``pack`` the word of them all."""
    with held(values.select(*columns), "alphabets") as rows:
        return [fit_alphabet(rows, c, fallback) for c in columns]


def channel_symbols(data: DataFrame, column: str = "x", at: tuple[float, ...] = (60, 75, 90)) -> tuple[Column, list[float]]:
    """Symbols of all channels of an array by percentiles of ln(1 + value) over all of them together; a value at a threshold belongs above it."""
    cuts = percentiles(data.select(F.explode(column).alias("v")), F.log1p("v"), list(at))
    rounded = [F.lit(round(t, DECIMALS)) for t in cuts]
    return F.transform(F.col(column), lambda v: reduce(lambda a, t: a + (F.round(F.log1p(v), DECIMALS) >= t).cast("int"), rounded, F.lit(0))), cuts


def one_hot_word(symbols: Column, channels: int, alphabet: int) -> Column:
    """One bit for each symbol and channel, or-ed: bit symbol * channels + channel."""
    bits = [F.expr("1L") * F.pow(F.lit(2.0), F.element_at(symbols, j + 1) * channels + j).cast("long") for j in range(channels)]
    if channels * alphabet > 62:
        raise ValueError("the words have more than 62 bits")
    return reduce(lambda a, b: a.bitwiseOR(b), bits)
