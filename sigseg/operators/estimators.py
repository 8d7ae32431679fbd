"""Strategies that are fitted to binned signals, classify others, and are saved and loaded; pipelines around them.

Signals are rows of chrom, bin, value or, for several tracks, chrom, bin, x
(``array<double>``). A segmentation is chrom, bin, state.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators import hmm as H
from sigseg.operators.em import Fit, Iterations, baum_welch
from sigseg.operators.multichannel import GaussianSegmenter, Pca, fit_segmenter
from sigseg.operators.signal import mappable_runs, resample
from sigseg.sources.writers import COLORS, bed9_rows, write_tsv

Stop = Callable[[float], bool]


class Strategy(ABC):
    """What a pipeline needs of a model."""

    model: H.HmmModel | None = None

    @abstractmethod
    def transform(self, signal: DataFrame) -> DataFrame:
        """chrom, bin, obs: the observations that the model sees; what it must learn for that is learned at the first call."""

    @abstractmethod
    def state(self) -> dict:
        """What ``restore`` needs, as JSON values."""

    @abstractmethod
    def restore(self, state: dict) -> None: ...

    def fit(self, signal: DataFrame, stop: Stop | None = None, chroms: list[str] | None = None, chunk: int = H.CHUNK) -> Fit:
        """Train on all sequences, or on those of the given chromosomes."""
        obs = self.transform(signal)
        obs = obs.filter(F.col("chrom").isin(chroms)) if chroms else obs
        got = baum_welch(H.pack(obs, chunk=chunk), self.model, stop or Iterations(10))
        self.model = got.model
        return got

    def classify(self, signal: DataFrame, chunk: int = H.CHUNK) -> DataFrame:
        return H.viterbi(H.pack(self.transform(signal), chunk=chunk), self.model)

    def posterior(self, signal: DataFrame, chunk: int = H.CHUNK) -> DataFrame:
        return H.posterior(H.pack(self.transform(signal), chunk=chunk), self.model)

    @property
    def name(self) -> str:
        return type(self).__name__.removesuffix("Strategy")

    @property
    def n_states(self) -> int:
        return self.model.n_states

    @property
    def state_names(self) -> list[str]:
        return ["closed", "open"] if self.n_states == 2 else [f"state {i}" for i in range(self.n_states)]

    @property
    def state_colors(self) -> list[str]:
        return [COLORS[i % len(COLORS)] for i in range(self.n_states)]


class DiscreteStrategy(Strategy):
    """Percentile symbols of ln(1 + value) and a discrete model."""

    def __init__(self, model: H.HmmModel | None = None, at: tuple[float, ...] = (60, 75, 90)) -> None:
        self.model, self.at, self.cuts = model or H.default_discrete(), at, None

    def transform(self, signal: DataFrame) -> DataFrame:
        x = signal.select("chrom", "bin", F.log1p("value").alias("x"))
        self.cuts = self.cuts or D.percentiles(x, "x", list(self.at))
        return x.select("chrom", "bin", D.above(F.col("x"), self.cuts).alias("obs"))

    def state(self) -> dict:
        return {"model": self.model.to_json(), "at": list(self.at), "cuts": self.cuts}

    def restore(self, state: dict) -> None:
        self.model, self.at, self.cuts = H.HmmModel.from_json(state["model"]), tuple(state["at"]), state["cuts"]


class NormalStrategy(Strategy):
    """ln(1 + value) and a normal model."""

    def __init__(self, model: H.HmmModel | None = None) -> None:
        self.model = model or H.default_normal()

    def transform(self, signal: DataFrame) -> DataFrame:
        return signal.select("chrom", "bin", F.log1p("value").alias("obs"))

    def state(self) -> dict:
        return {"model": self.model.to_json()}

    def restore(self, state: dict) -> None:
        self.model = H.HmmModel.from_json(state["model"])


class ChannelsStrategy(Strategy):
    """Principal components of several tracks and a Gaussian model of them."""

    def __init__(self, states: int = 2, dims: int | None = None, seed: int = 1) -> None:
        self.states, self.dims, self.seed, self.pca = states, dims, seed, None

    def transform(self, signal: DataFrame) -> DataFrame:
        if self.pca is None:
            raise ValueError("fit first")
        return signal.select("chrom", "bin", self.pca.transform(F.col("x")).alias("obs"))

    def fit(self, signal: DataFrame, stop: Stop | None = None, chroms: list[str] | None = None, chunk: int = H.CHUNK) -> Fit:
        some = signal.filter(F.col("chrom").isin(chroms)) if chroms else signal
        made: GaussianSegmenter = fit_segmenter(some, self.states, self.dims, seed=self.seed, chunk=chunk, stop=stop)
        self.pca, self.model = made.pca, made.fit.model
        return made.fit

    def state(self) -> dict:
        return {"model": self.model.to_json(), "pca": asdict(self.pca)}

    def restore(self, state: dict) -> None:
        self.model, self.pca = H.HmmModel.from_json(state["model"]), Pca(**state["pca"])
        self.states = self.model.n_states


class ChannelSymbolsStrategy(Strategy):
    """Symbols of several tracks by common percentiles, and a model of independent symbols."""

    def __init__(self, channels: int, at: tuple[float, ...] = (60, 75, 90), model: H.HmmModel | None = None) -> None:
        self.channels, self.at, self.cuts, n = channels, at, None, len(at) + 1
        low = [2.0 * (n - i) / (n * (n + 1)) for i in range(n)]
        self.model = model or H.HmmModel(H.DEFAULT_START, H.DEFAULT_TRANSITION, E.Multinomial([[low] * channels, [low[::-1]] * channels]), H.DEFAULT_END)

    def transform(self, signal: DataFrame) -> DataFrame:
        if self.cuts is None:
            _, self.cuts = D.channel_symbols(signal, at=self.at)
        rounded = [round(t, D.DECIMALS) for t in self.cuts]
        symbol = lambda v: sum(((F.round(F.log1p(v), D.DECIMALS) >= F.lit(t)).cast("int") for t in rounded), F.lit(0))
        return signal.select("chrom", "bin", F.transform("x", symbol).alias("obs"))

    def state(self) -> dict:
        return {"model": self.model.to_json(), "channels": self.channels, "at": list(self.at), "cuts": self.cuts}

    def restore(self, state: dict) -> None:
        self.model, self.channels, self.at, self.cuts = H.HmmModel.from_json(state["model"]), state["channels"], tuple(state["at"]), state["cuts"]


REGISTRY: dict[str, Callable[[], Strategy]] = {
    "Discrete": DiscreteStrategy, "Normal": NormalStrategy, "Channels": ChannelsStrategy, "ChannelSymbols": lambda: ChannelSymbolsStrategy(1),
}


class Segmenter:
    """A strategy at a resolution of a whole number of bins, under a name."""

    def __init__(self, strategy: Strategy, resolution: int = 1, name: str | None = None) -> None:
        if not isinstance(resolution, int) or resolution < 1:
            raise ValueError("the resolution is a whole number of bins")
        self.strategy, self.resolution, self.name = strategy, resolution, name or f"{strategy.name}{resolution}"

    def at_resolution(self, signal: DataFrame) -> DataFrame:
        """The signal in bins of the resolution; tracks are joined one by one."""
        if self.resolution == 1:
            return signal
        if "x" not in signal.columns:
            return resample(signal, self.resolution)
        long = signal.select("chrom", "bin", F.posexplode("x").alias("i", "value"))
        keyed = long.select(F.struct("chrom", "i").alias("chrom"), "bin", "value")
        wide = resample(keyed, self.resolution).groupBy("chrom.chrom", "bin").agg(F.array_sort(F.collect_list(F.struct("chrom.i", "value"))).alias("a"))
        return wide.select("chrom", "bin", F.col("a.value").alias("x"))

    def fit(self, signal: DataFrame, stop: Stop | None = None, chroms: list[str] | None = None) -> Fit:
        return self.strategy.fit(self.at_resolution(signal), stop, chroms)

    def fit_mappable(self, signal: DataFrame, mappability: DataFrame, stop: Stop | None = None, threshold: float = 0.7, min_bins: int = 100) -> Fit:
        """Train on the mappable runs, each a sequence of its own. ``mappability``: chrom, bin, value, at the resolution."""
        parts = mappable_runs(mappability, threshold, min_bins)
        return self.strategy.fit(split_sequences(self.at_resolution(signal), parts), stop)

    def classify(self, signal: DataFrame) -> DataFrame:
        return self.strategy.classify(self.at_resolution(signal))

    def publish(self, segmentation: DataFrame, path: str, bin_size: int) -> None:
        """Write the runs of a segmentation as nine BED columns."""
        write_tsv(bed9_rows(segmentation, bin_size * self.resolution, self.strategy.state_names), path)

    def save(self, spark: SparkSession, root: str, mode: str = "error") -> str:
        """Write the model to a folder of its own below ``root``; ``mode`` as Spark's writers take it."""
        content = {"strategy": self.strategy.name, "resolution": self.resolution, "name": self.name, "state": self.strategy.state()}
        spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(model_dir(root, self.name))
        return model_dir(root, self.name)

    @staticmethod
    def load(spark: SparkSession, root: str, name: str) -> Segmenter:
        content = json.loads(spark.read.text(model_dir(root, name)).first()["value"])
        strategy = REGISTRY[content["strategy"]]()
        strategy.restore(content["state"])
        return Segmenter(strategy, content["resolution"], content["name"])


def model_dir(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/model={name}"


def saved_models(spark: SparkSession, root: str) -> list[str]:
    """Names of the models below ``root``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(s.getPath().getName().removeprefix("model=") for s in files.listStatus(path) if s.getPath().getName().startswith("model="))


def split_sequences(signal: DataFrame, parts: DataFrame) -> DataFrame:
    """The bins inside the parts (chrom, start, length), each part a sequence from bin 0 on under the name chrom:start."""
    blocks = parts.withColumn("block", F.explode(F.sequence(F.expr("start div 4096"), F.expr("(start + length - 1) div 4096"))))
    inside = signal.withColumn("block", F.expr("bin div 4096")).join(blocks, ["chrom", "block"]).filter((F.col("bin") >= F.col("start")) & (F.col("bin") < F.col("start") + F.col("length")))
    rest = [c for c in signal.columns if c not in ("chrom", "bin")]
    return inside.select(F.concat_ws(":", "chrom", "start").alias("chrom"), (F.col("bin") - F.col("start")).alias("bin"), *rest)
