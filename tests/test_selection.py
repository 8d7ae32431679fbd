"""The grid, its scorers and the training regions against plain loops over numpy arrays."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators import em
from sigseg.operators import hmm as H
from sigseg.operators import scoring as C
from sigseg.operators import selection as L
from sigseg.operators import signal as S
from sigseg.operators.regions import nearest_start
from sigseg.plans import catalogue
from sigseg.plans import views as V

SF = "/root/testdata/sf0.001"


def densities(kind, e, x):
    if kind == "discrete":
        return e[:, x.astype(int)].transpose(1, 2, 0)
    m, s = e
    return np.maximum(np.exp(-((x[..., None] - m) ** 2) / (2 * s * s)) / (s * np.sqrt(2 * np.pi)), E.FLOOR)


def one_round(kind, start, a, e, x):
    """Log-likelihood and the next model; x is [sequences, bins]."""
    d = densities(kind, e, x)
    n, t, k = d.shape
    alpha, beta, c = np.zeros((n, t, k)), np.ones((n, t, k)), np.zeros((n, t))
    for i in range(t):
        v = (start if i == 0 else alpha[:, i - 1] @ a) * d[:, i]
        c[:, i] = v.sum(1)
        alpha[:, i] = v / c[:, i, None]
    for i in range(t - 2, -1, -1):
        beta[:, i] = (d[:, i + 1] * beta[:, i + 1]) @ a.T / c[:, i + 1, None]
    gamma = alpha * beta
    pairs = (alpha[:, :-1, :, None] * a * (d[:, 1:] * beta[:, 1:] / c[:, 1:, None])[:, :, None, :]).sum((0, 1))
    weight = gamma.sum((0, 1))
    if kind == "discrete":
        new = np.stack([[gamma[x == m][:, s].sum() for m in range(e.shape[1])] for s in range(k)]) / weight[:, None]
    else:
        means = (gamma * x[..., None]).sum((0, 1)) / weight
        new = means, np.maximum(np.sqrt((gamma * (x[..., None] - e[0]) ** 2).sum((0, 1)) / weight), 0.5)
    first = gamma[:, 0].sum(0)
    return np.log(c).sum(), first / first.sum(), pairs / pairs.sum(1, keepdims=True), new


def decode(kind, start, a, end, e, x):
    with np.errstate(divide="ignore"):
        d, la = np.log(densities(kind, e, x)), np.log(a)
        value, back = np.log(start) + d[:, 0], []
        for i in range(1, x.shape[1]):
            both = value[:, :, None] + la
            back.append(both.argmax(1))
            value = both.max(1) + d[:, i]
    at = (value + np.log(end)).argmax(1)
    out = [at]
    for b in reversed(back):
        at = b[np.arange(len(b)), at]
        out.append(at)
    return np.stack(out[::-1], 1)


def floored(a, least):
    a = a.copy()
    if a[1, 1] < least:
        a[1] = [1 - least, least]
    return a


@pytest.fixture(scope="module")
def arrays(spark):
    mc = np.zeros((4, 5, 720))
    rows = V.mc_hour(spark, SF).collect()
    chroms = sorted({r.chrom for r in rows})
    for r in rows:
        mc[r.track, chroms.index(r.chrom), r.bin] = r.value
    sig = np.zeros((5, 720))
    for r in V.sig_hour(spark, SF).collect():
        sig[chroms.index(r.chrom), r.bin] = r.value
    return sig, mc


def test_grid_equals_plain_loops(spark, arrays):
    sig, mc = arrays
    got = {(r.factor, r.family, r.floor): r for r in catalogue.sel_grid(spark, SF).collect()}
    assert len(got) == 56
    for factor in L.FACTORS:
        at, tracks = sig.reshape(5, -1, factor).sum(2), mc.reshape(4, 5, -1, factor).sum(3)
        cuts = np.array(D.percentiles(spark.createDataFrame([(float(v),) for v in np.log1p(at).ravel()], "v double"), "v", [60, 75, 90]))
        for family in L.FAMILIES:
            read = (lambda v: np.log1p(v)) if family == "normal" else (lambda v: (np.log1p(v)[..., None] > cuts).sum(-1))  # noqa: B023
            for floor in L.FLOORS:
                e = (np.array([0.0, 2.0]), np.array([1.0, 2.5])) if family == "normal" else np.array(H.DEFAULT_TABLE)
                start, a = np.array(H.DEFAULT_START), np.array([[0.99, 0.01], [1 - max(0.9, floor), max(0.9, floor)]])
                for _ in range(5):
                    loglik, start, a, e = one_round(family, start, a, e, read(at))
                    a = floored(a, floor)
                x = read(tracks).reshape(20, -1)
                state = decode(family, start, a, np.array(H.DEFAULT_END), e, x).reshape(tracks.shape)
                mean = state.mean(0)
                sure = (mean <= 0.2) | (mean >= 0.8)
                agree = np.mean([(s[sure] == (mean >= 0.8)[sure]).mean() for s in state])
                over = []
                for v in tracks:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        over.append((v * (state == 1)).sum() / (state == 1).sum() / ((v * (state == 0)).sum() / (state == 0).sum()))
                row = got[factor, family, floor]
                assert row.loglik == pytest.approx(loglik / at.size, abs=2e-6)
                assert row.consistency == pytest.approx(agree, abs=2e-6)
                assert row.loglik_samples == pytest.approx(one_round(family, start, a, e, x)[0] / x.size, abs=2e-6)
                assert row.enrichment is None if state.min() == 1 or state.max() == 0 else row.enrichment == pytest.approx(np.mean(over), rel=1e-5)


def test_scorers_by_cell_equal_their_single_queries(spark):
    samples = V.mc_hour(spark, SF).filter("track < 2 and chrom in ('click', 'view')").select(F.col("track").cast("string").alias("sample"), "chrom", "bin", "value")
    train = V.sig_hour(spark, SF).filter("chrom in ('click', 'view')")
    trial = L.train_grid(train, samples, 2, (1, 4), ("normal",), (0.0, 0.99), chunk=256)
    peaks, genes = V.peaks(spark, SF), catalogue._genes(spark, SF)
    scorers = [L.ConsistencyScorer(), L.NearestScorer(peaks, 3600, 0.5), L.GenesScorer(genes, 3600, 10)]
    got = {(r.factor, r.floor): r for r in L.score_grid(trial, scorers).collect()}
    assert len(got) == 4 and set(L.SCORERS) == {"consistency", "enrichment", "likelihood", "nearest", "genes"}
    for factor, floor in got:
        cell = f"{factor}|normal|{floor}"
        states = trial.states.filter(F.col("cell") == cell).drop("cell").cache()
        assert got[factor, floor].consistency == pytest.approx(C.consistency(states).agg(F.avg("score")).first()[0])
        near, broken = [], []
        for sample in ("0", "1"):
            runs = S.runs(states.filter(F.col("sample") == sample)).withColumn("start", F.col("start") * factor).withColumn("length", F.col("length") * factor)
            gaps = C.peak_gaps(peaks.filter("chrom in ('click', 'view')"))
            scaled = runs.select("chrom", (F.col("start") * 3600).alias("start"), (F.col("length") * 3600).alias("length"))
            near += [r.score for r in C.gap_agreement(nearest_start(gaps.drop("gap"), scaled), gaps, 0.5).collect()]
            # shuffles are drawn by the name of the sequence, so the single test must bear it
            named = runs.withColumn("chrom", F.concat_ws("\x1f", F.lit(cell), F.lit(sample), "chrom"))
            own = genes.filter("chrom in ('click', 'view')").withColumn("chrom", F.concat_ws("\x1f", F.lit(cell), F.lit(sample), "chrom"))
            broken += [r.score for r in C.permutation_test(named, own, 10, 3600).collect()]
        assert got[factor, floor].nearest == pytest.approx(np.mean(near)) if near else got[factor, floor].nearest is None
        assert got[factor, floor].genes == pytest.approx(np.mean(broken))


@pytest.mark.parametrize("parts", [3, 10])
def test_training_regions_equal_plain_loops(spark, parts):
    rng = np.random.default_rng(3)
    data = {"a": rng.integers(0, 4, 217), "b": np.sort(rng.integers(0, 4, 90))}
    df = spark.createDataFrame([(c, i, int(v)) for c, x in data.items() for i, v in enumerate(x)], "chrom string, bin long, obs int")
    got = {r.part: r for r in L.training_regions(df, "a", "b", parts, 4, 8).collect()}
    width, found = 217 // parts, []
    for i in range(parts):
        start, a, e = np.array(H.DEFAULT_START), np.array(H.DEFAULT_TRANSITION), np.array(H.DEFAULT_TABLE)
        for _ in range(4):
            _, start, a, e = one_round("discrete", start, a, e, data["a"][None, i * width : (i + 1) * width])
        found.append(one_round("discrete", start, a, (e + 1e-6) / (1 + 4e-6), data["b"][None])[0])
        assert got[i].loglik == pytest.approx(found[-1], rel=1e-9)
    assert len(got) == parts and [r.part for r in got.values() if r.best] == [int(np.argmax(found))]
    with pytest.raises(ValueError, match="parts"):
        L.training_regions(df, "a", "b", 300)


def test_a_state_that_is_never_met_stays(spark):
    never = H.HmmModel([1.0, 0.0], [[1.0, 0.0], [0.5, 0.5]], E.Normal([0.0, 9.0], [1.0, 2.0]))
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)], "chrom string, bin long, obs double")
    fit = em.baum_welch(H.pack(df), never, em.Iterations(2))
    assert fit.model.emission.means == pytest.approx([1.0, 9.0]) and fit.model.emission.deviations[1] == 2.0 and fit.model.transition[1] == [0.5, 0.5]


def tasks_of(spark, run):
    """Tasks of all jobs of ``run``, and what it gives."""
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        given, tracker = run(), spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
        return sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x), given
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_of_training_have_few_tasks_however_many_partitions_made_the_signal(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, int(x)) for c in ("a", "b") for i, x in enumerate(rng.integers(0, 4, 400))]
    df = spark.createDataFrame(rows, "chrom string, bin long, obs int")
    few, want = tasks_of(spark, lambda: L.training_regions(df, "a", "b", 4, 5, 64).collect())
    many, got = tasks_of(spark, lambda: L.training_regions(df.repartition(200, "chrom", "bin"), "a", "b", 4, 5, 64).collect())
    assert [(r.part, r.best) for r in got] == [(r.part, r.best) for r in want]
    assert [r.loglik for r in got] == pytest.approx([r.loglik for r in want])
    packed = H.pack(df, chunk=4).repartition(200)
    n, fit = tasks_of(spark, lambda: em.baum_welch(packed, H.default_discrete(), em.Iterations(5)))
    assert len(fit.likelihoods) == 5 and many < few + 400 and n < 500


def test_fits_have_few_tasks_however_many_partitions_made_the_values(spark):
    rows = [(float(x), float(y)) for x, y in np.random.default_rng(4).exponential(9, (300, 2)).round(2)]
    df = spark.createDataFrame(rows, "u double, v double").repartition(100)
    n, fitted = tasks_of(spark, lambda: D.fit_alphabets(df, ["u", "v"]))
    assert [a.kind.startswith("exponential") for a in fitted] == [True, True] and n < 3000
