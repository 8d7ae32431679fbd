"""Model selection: grids of parameters, regions to train on, transition priors.

A grid is trained, decoded and scored as one: its cells are a key of the packed
signal, so a round of training, the decoding of all samples and each score are
one job for all cells. Only models (a few numbers for each cell) are on the driver.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators.em import baum_welch_cells
from sigseg.operators.hmm import DEFAULT_END, DEFAULT_START, DEFAULT_TABLE, HmmModel, default_discrete, default_normal, log_likelihood_cells, pack, viterbi, viterbi_runs
from sigseg.operators.regions import nearest_start
from sigseg.operators.scoring import consistency, gap_agreement, peak_gaps, permutation_test, ratio
from sigseg.operators.signal import resample
from sigseg.sources.folders import scratch_folder

#: Fixed values of the search: resolutions, families, and least self transitions of the open state.
FACTORS, FAMILIES, FLOORS = (1, 2, 4, 8), ("discrete", "normal"), (0.0, 0.9, 0.95, 0.99, 0.999, 0.9999, 0.99999)
#: Between the parts of a name.
SEP = "\x1f"


@dataclass(frozen=True)
class Trial:
    """A grid after training, as scorers see it. A cell is named by ``cell``."""

    cells: DataFrame  # cell, factor, family, floor, loglik (of a bin of the training signal, under the last model but one)
    models: dict[str, HmmModel]
    packed: DataFrame  # the samples of each cell: cell, sample, chrom, chunk, obs
    states: DataFrame  # cell, sample, chrom, bin, state

    @property
    def runs(self) -> DataFrame:
        """cell, sample, chrom, region, start, length, state; starts and lengths in bins of the finest resolution."""
        found = viterbi_runs(self.packed, self.models, keys=("cell", "sample", "chrom")).join(F.broadcast(self.cells.select("cell", "factor")), "cell")
        return found.withColumn("start", F.col("start") * F.col("factor")).withColumn("length", F.col("length") * F.col("factor")).drop("factor")


class Scorer(ABC):
    """Gives ``cell, score`` for the cells of a trial; a cell that cannot be judged is absent or null."""

    name: str

    @abstractmethod
    def score(self, trial: Trial) -> DataFrame: ...


class ConsistencyScorer(Scorer):
    """Mean agreement of the samples where most of them agree."""

    name = "consistency"

    def score(self, trial: Trial) -> DataFrame:
        return consistency(trial.states, by=("cell",)).groupBy("cell").agg(F.avg("score").alias("score"))


class EnrichmentScorer(Scorer):
    """Mean, over the tracks of a signal (chrom, bin, track, value), of the values in open bins of the samples over those in closed ones."""

    name = "enrichment"

    def __init__(self, signal: DataFrame) -> None:
        self.signal = signal

    def score(self, trial: Trial) -> DataFrame:
        factors = F.broadcast(trial.cells.select("cell", "factor"))
        open_, closed = F.count_if(F.col("state") == 1), F.count_if(F.col("state") == 0)
        counted = trial.states.groupBy("cell", "chrom", "bin").agg(open_.alias("n1"), closed.alias("n0")).join(factors, "cell")
        each = F.broadcast(trial.cells.select("factor").distinct())
        # a row of the signal meets each resolution once: the factors are a handful
        at = self.signal.join(each, F.lit(True)).groupBy("factor", "chrom", "track", F.expr("bin div factor").alias("bin")).agg(F.sum("value").alias("value"))
        mean = lambda n: F.try_divide(F.sum(F.col("value") * F.col(n)), F.sum(n))
        per_track = counted.join(at, ["factor", "chrom", "bin"]).groupBy("cell", "track").agg(mean("n1").alias("inside"), mean("n0").alias("outside"))
        return per_track.withColumn("score", ratio(F.col("inside"), F.col("outside"))).groupBy("cell").agg(F.avg("score").alias("score"))


class LikelihoodScorer(Scorer):
    """Log-likelihood of a bin: of the training signal before the last step (``training``), or of the samples under the trained model (``samples``)."""

    def __init__(self, of: str = "training") -> None:
        self.of, self.name = of, f"loglik_{of}"

    def score(self, trial: Trial) -> DataFrame:
        if self.of == "training":
            return trial.cells.select("cell", F.col("loglik").alias("score"))
        bins = trial.packed.groupBy("cell").agg(F.sum(F.size("obs")).alias("bins"))
        return log_likelihood_cells(trial.packed, trial.models).join(bins, "cell").select("cell", (F.col("loglik") / F.col("bins")).alias("score"))


def _named(rows: DataFrame) -> DataFrame:
    """``chrom`` as the name of cell, sample and chromosome together."""
    return rows.withColumn("chrom", F.concat_ws(SEP, "cell", "sample", "chrom"))


def _for_each_cell(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Copies of ``rows`` (chrom, ...) for each cell and sample that has runs on their chromosome."""
    return _named(rows.join(F.broadcast(runs.select("cell", "sample", "chrom").distinct()), "chrom")).drop("cell", "sample")


def _by_cell(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.substring_index("chrom", SEP, 1).alias("cell")).agg(F.avg("score").alias("score"))


class NearestScorer(Scorer):
    """Mean over samples and chromosomes of the regions that are as long as the gap behind their nearest peak (``gap_agreement``)."""

    name = "nearest"

    def __init__(self, peaks: DataFrame, bin_size: int, tolerance: float = 0.1) -> None:
        self.peaks, self.bin_size, self.tolerance = peaks, bin_size, tolerance

    def score(self, trial: Trial) -> DataFrame:
        runs = trial.runs
        scaled = _named(runs).select("chrom", (F.col("start") * self.bin_size).alias("start"), (F.col("length") * self.bin_size).alias("length"))
        gaps = _for_each_cell(peak_gaps(self.peaks), runs)
        return _by_cell(gap_agreement(nearest_start(gaps.drop("gap"), scaled), gaps, self.tolerance))


class GenesScorer(Scorer):
    """Mean over samples and chromosomes of the share of shuffled segmentations that break more genes (``permutation_test``)."""

    name = "genes"

    def __init__(self, genes: DataFrame, bin_size: int, permutations: int = 500, seed: int = 1) -> None:
        self.genes, self.bin_size, self.permutations, self.seed = genes, bin_size, permutations, seed

    def score(self, trial: Trial) -> DataFrame:
        runs = trial.runs
        named = _named(runs).select("chrom", "region", "start", "length", "state")
        return _by_cell(permutation_test(named, _for_each_cell(self.genes, runs), self.permutations, self.bin_size, self.seed))


#: The scorers by name.
SCORERS: dict[str, type[Scorer]] = {"consistency": ConsistencyScorer, "enrichment": EnrichmentScorer, "likelihood": LikelihoodScorer, "nearest": NearestScorer, "genes": GenesScorer}


def first_model(family: str, floor: float) -> HmmModel:
    """A family's default model whose open state stays with at least ``floor``."""
    base, stay = default_discrete() if family == "discrete" else default_normal(), max(0.9, floor)
    return replace(base, transition=[base.transition[0], [1 - stay, stay]])


def _observed(signals: dict[int, DataFrame], families: tuple[str, ...], cuts: dict[int, list[float]], keys: tuple[str, ...]) -> DataFrame:
    """grid, keys, bin, obs: the signal of each resolution as each family reads it."""
    parts = []
    for factor, signal in signals.items():
        x = F.log1p("value")
        for family in families:
            obs = x if family == "normal" else D.above(x, cuts[factor])
            parts.append(signal.select(F.lit(f"{factor}|{family}").alias("grid"), *keys, "bin", obs.cast("double").alias("obs")))
    return reduce(DataFrame.unionByName, parts)


def _written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` written to ``path`` and read from there, so that what follows does not compute them again."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _in_cells(observed: DataFrame, cells: DataFrame, keys: tuple[str, ...], chunk: int, path: str) -> DataFrame:
    """Packed once for each resolution and family and written to ``path``, then copied to the cells that read them alike."""
    packed = _written(pack(observed, chunk=chunk, keys=("grid", *keys)), path)
    return packed.join(F.broadcast(cells.select("grid", "cell")), "grid").drop("grid").withColumn("seq", F.concat_ws(SEP, "cell", *keys))


def train_grid(train: DataFrame, samples: DataFrame, rounds: int = 5, factors=FACTORS, families=FAMILIES, floors=FLOORS, chunk: int = 4096) -> Trial:
    """Fit every cell on ``train`` (chrom, bin, value) and decode ``samples`` (sample, chrom, bin, value) by it.

    A cell is a resolution (sums of ``factor`` bins), a family and the least self
    transition of its open state. The discrete family cuts samples where it cuts
    the training signal of that resolution.
    """
    spark = train.sparkSession
    names = {f"{factor}|{family}|{floor}": (factor, family, floor) for factor in factors for family in families for floor in floors}
    cells = spark.createDataFrame([(f"{x}|{y}", c, x, y, z) for c, (x, y, z) in names.items()], "grid string, cell string, factor int, family string, floor double")
    folder = scratch_folder(spark, "grid")
    # each resolution and family reads them
    train, samples = _written(train, f"{folder}/train_signal"), _written(samples, f"{folder}/sample_signals")
    signals = {f: train if f == 1 else resample(train, f) for f in factors}
    cuts = {f: D.percentiles(s.select("chrom", "bin", F.log1p("value").alias("obs")), "obs", [60, 75, 90]) for f, s in signals.items()} if "discrete" in families else {}
    bins = {r.factor: r.n for r in reduce(DataFrame.unionByName, [s.select(F.lit(f).alias("factor")) for f, s in signals.items()]).groupBy("factor").agg(F.count("*").alias("n")).collect()}
    packed = _in_cells(_observed(signals, families, cuts, ("chrom",)), cells, ("chrom",), chunk, f"{folder}/train")
    models = {c: first_model(family, floor) for c, (_, family, floor) in names.items()}
    fits = baum_welch_cells(packed, models, rounds, {c: [0.0, floor] for c, (_, _, floor) in names.items()})
    rows = [(c, *x, fits[c].likelihoods[-1] / bins[x[0]] if fits[c].likelihoods else None) for c, x in names.items()]
    keys = ("sample", "chrom")
    copies = {f: samples if f == 1 else resample(samples, f, keys=keys) for f in factors}
    held = _in_cells(_observed(copies, families, cuts, keys), cells, keys, chunk, f"{folder}/samples")
    trained = {c: f.model for c, f in fits.items()}
    states = _written(viterbi(held, trained, keys=("cell", *keys)), f"{folder}/states")  # each scorer reads it
    table = spark.createDataFrame(rows, "cell string, factor int, family string, floor double, loglik double")
    return Trial(table, trained, held, states)


def score_grid(trial: Trial, scorers: list[Scorer]) -> DataFrame:
    """factor, family, floor, loglik, and a column for each scorer, null where it cannot judge."""
    table = trial.cells
    for s in scorers:
        table = table.join(s.score(trial).withColumnRenamed("score", s.name), "cell", "left")
    return table.drop("cell")


def prior_sweep(packed: DataFrame, leave_open: list[float], leave_closed: list[float], rounds: int = 2) -> list[tuple]:
    """(leave open, leave closed, log-likelihood) over a grid of first transitions; ``packed`` has one key. A round is one job for all cells."""
    cells = {f"{p}|{q}": (p, q) for p in leave_open for q in leave_closed}
    models = {c: HmmModel(DEFAULT_START, [[1 - q, q], [p, 1 - p]], E.Discrete(DEFAULT_TABLE), DEFAULT_END) for c, (p, q) in cells.items()}
    copies = packed.withColumn("cell", F.explode(F.array(*map(F.lit, cells)))).withColumn("seq", F.concat_ws(SEP, "cell", "seq"))
    fits = baum_welch_cells(copies, models, rounds)
    return [(*cells[c], fits[c].likelihoods[-1]) for c in cells]


def training_regions(symbols: DataFrame, train: str, test: str, parts: int, rounds: int = 5, chunk: int = 4096) -> DataFrame:
    """part, loglik, best: models that were each trained on one part of the training chromosome, judged by the test chromosome.

    Parts are of equal length, the remainder is left out. All parts are trained
    in one job a round and judged in one. What a part never shows gets a share of
    a millionth. Of equal ones, the first part is the best.
    """
    spark = symbols.sparkSession
    symbols = _written(symbols.filter(F.col("chrom").isin(train, test)), scratch_folder(spark, "regions"))  # four jobs and the result read them
    size = symbols.filter(F.col("chrom") == train).agg(F.max("bin") + 1).first()[0] or 0
    width = size // parts
    if not width:
        raise ValueError("there are more parts than bins")
    piece = F.expr(f"bin div {width}")
    cut = symbols.filter((F.col("chrom") == train) & (F.col("bin") < parts * width)).select(piece.cast("string").alias("cell"), "chrom", F.expr(f"bin % {width}").alias("bin"), "obs")
    fits = baum_welch_cells(pack(cut, chunk=chunk, keys=("cell", "chrom")), {str(i): default_discrete() for i in range(parts)}, rounds)
    models = {}
    for c, fit in fits.items():
        m = fit.model
        smooth = [[(v + 1e-6) / (1 + 1e-6 * len(row)) for v in row] for row in m.emission.table]
        models[c] = HmmModel(m.start, m.transition, E.Discrete(smooth))
    held = pack(symbols.filter(F.col("chrom") == test), chunk=chunk)
    names = spark.createDataFrame([(c,) for c in models], "cell string")
    copies = held.join(F.broadcast(names), F.lit(True)).withColumn("seq", F.concat_ws(SEP, "cell", "chrom"))
    found = log_likelihood_cells(copies, models).select(F.col("cell").cast("int").alias("part"), "loglik")
    first = F.row_number().over(Window.orderBy(F.desc("loglik"), "part"))  # a row for each part
    return found.select("part", "loglik", (first == 1).alias("best"))
