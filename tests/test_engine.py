"""Parts that the queries do not reach: other sizes, other paths, files, estimators and hooks."""

import math

import numpy as np
import pytest

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators import em
from sigseg.operators import estimators as T
from sigseg.operators import hmm as H
from sigseg.operators import multichannel as M
from sigseg.operators import regions as R
from sigseg.operators import scoring as C
from sigseg.operators import signal as S
from sigseg.operators import wavelet as W
from sigseg.sources import readers, writers


def test_runs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_BLOCK", 4)
    states = [0] * 9 + [1] * 4 + [0] + [1] * 10
    rows = [("c", i, s) for i, s in enumerate(states)] + [("c", 30, 1), ("d", 3, None), ("d", 4, None), ("d", 5, 2)]
    got = S.runs(spark.createDataFrame(rows, "chrom string, bin long, state int").repartition(3)).orderBy("chrom", "region")
    assert [tuple(r) for r in got.collect()] == [("c", 0, 0, 9, 0), ("c", 1, 9, 4, 1), ("c", 2, 13, 1, 0), ("c", 3, 14, 10, 1), ("c", 4, 30, 1, 1), ("d", 0, 3, 2, None), ("d", 1, 5, 1, 2)]
    assert S.runs(spark.createDataFrame([], "chrom string, bin long, state int")).count() == 0


@pytest.mark.parametrize("bucket", [7, 1000])
def test_nearest_start_equals_brute_force(spark, bucket):
    rng = np.random.default_rng(1)
    starts = sorted(set(rng.integers(0, 300, 12).tolist()))
    peaks = [("c", i, float(x)) for i, x in enumerate(rng.integers(0, 700, 80) / 2)] + [("none", 900, 5.0)]
    regions = spark.createDataFrame([("c", s, 10 + s) for s in starts], "chrom string, start long, length long")
    got = {r.id: (r.start, r.length) for r in R.nearest_start(spark.createDataFrame(peaks, "chrom string, id long, pos double"), regions, bucket).collect()}
    for _, i, x in peaks[:-1]:
        best = min(starts, key=lambda s: (abs(x - s), -s))
        assert got[i] == (best, 10 + best)
    assert got[900] == (None, None)


def test_percentiles_by_brackets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(D, "DIRECT", 50)
    monkeypatch.setattr(D, "ACCURACY", 100)
    for values in (rng.normal(size=3000).tolist(), rng.integers(0, 4, 3000).astype(float).tolist(), [1.0] * 200):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
        at = [0.0, 1.0, 33.3, 50.0, 90.0, 100.0]
        assert D.percentiles(df, "v", at) == pytest.approx(np.percentile(values, at).tolist())
    assert all(map(math.isnan, D.percentiles(df.limit(0), "v", [10.0])))


def test_cells_train_as_alone(spark):
    rng = np.random.default_rng(3)
    obs = spark.createDataFrame([(c, i, float(rng.integers(0, 4))) for c in ("a", "b") for i in range(150)], "chrom string, bin long, obs double")
    cells = {"x": H.default_discrete(), "y": H.HmmModel([0.5, 0.5], [[0.7, 0.3], [0.2, 0.8]], E.Discrete(H.DEFAULT_TABLE), [0.5, 0.5]), "z": H.default_normal()}
    packed = H.pack(obs.crossJoin(spark.createDataFrame([(c,) for c in cells], "cell string")), chunk=32, keys=("cell", "chrom"))
    got = em.baum_welch_cells(packed, cells, 2, {"y": [0.0, 0.95]})
    for c, first in cells.items():
        alone = em.baum_welch(H.pack(obs, chunk=32), first, em.Iterations(2), [0.0, 0.95] if c == "y" else 0.0)
        assert got[c].likelihoods == pytest.approx(alone.likelihoods)
        assert np.allclose(got[c].model.transition, alone.model.transition)
    assert got["y"].model.transition[1][1] >= 0.95 - 1e-12


def test_interrupt_keeps_the_model(spark):
    obs = spark.createDataFrame([("a", i, float(i // 7 % 4)) for i in range(60)], "chrom string, bin long, obs double")
    seen = []

    def stop(likelihood):
        seen.append(likelihood)
        if len(seen) == 2:
            raise KeyboardInterrupt
        return False

    fit = em.baum_welch(H.pack(obs), H.default_discrete(), stop)
    assert len(fit.likelihoods) == 2 and fit.model != H.default_discrete()


def test_var_center_and_small_change(spark):
    rng = np.random.default_rng(4)
    obs = spark.createDataFrame([("a", i, float(rng.normal(3 * (i // 40 % 2), 1))) for i in range(240)], "chrom string, bin long, obs double")
    stop = em.SmallChange(1.0, 12)
    fit = em.baum_welch(H.pack(obs, chunk=64), H.default_normal(), stop, var_center="new")
    steps = np.diff(stop.likelihoods)
    assert (steps > -1e-6).all() and (len(stop.likelihoods) == 12 or (np.abs(steps[-3:]) < 1.0).all())
    assert fit.model.emission.means == pytest.approx([0, 3], abs=0.4)


def test_singular_and_mixed_normals(spark):
    x = np.array([[1.0, 1.0, 5.0], [0.3, 0.3, 0.0]])
    one = E.MultivariateNormal([[0.0, 0.0, 0.0]], [[[1.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 4.0]]])
    expected = [-0.5 * (2 * math.log(2 * math.pi) + math.log(2) + math.log(4)) - (a * a * 2 / 2 + c * c / 4) / 2 for a, _, c in x]
    expected = [-0.5 * (2 * math.log(2 * math.pi) + math.log(2.0) + math.log(4.0)) - 0.5 * ((2 * a) ** 2 / 4 + c * c / 4) for a, _, c in x]
    assert one.log_densities(x)[:, 0] == pytest.approx(expected)
    rng = np.random.default_rng(5)
    data = [("a", i, (rng.normal(0, 1, 2) + 4 * (i // 50 % 2) + (3 if rng.random() < 0.5 else 0)).tolist()) for i in range(300)]
    first = E.MultivariateMixture([[0.5, 0.5]] * 2, [[[0.0, 0.0], [2.0, 2.0]], [[4.0, 4.0], [8.0, 8.0]]], [[np.eye(2).tolist()] * 2] * 2)
    fit = em.baum_welch(H.pack(spark.createDataFrame(data, "chrom string, bin long, obs array<double>"), chunk=64), H.HmmModel([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], first), em.Iterations(4))
    assert (np.diff(fit.likelihoods) > 0).all()
    assert H.HmmModel.from_json(fit.model.to_json()) == fit.model


def test_channels(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 3)) + 6 * (np.arange(400) // 50 % 2)[:, None]
    data = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "chrom string, bin long, x array<double>").repartition(3)
    n, s, p = M.moments(data)
    assert n == 400 and s == pytest.approx(x.sum(0)) and p == pytest.approx(x.T @ x)
    means, covariances, weights = M.soft_clusters(data, 2)
    assert np.allclose(means, [[0] * 3, [6] * 3], atol=0.5) and sum(weights) == pytest.approx(1) and np.shape(covariances) == (2, 3, 3)
    made = M.fit_segmenter(data, 2, dims=2, rounds=3, chunk=64)
    states = np.array([r.state for r in H.viterbi(made.pack(data, 64), made.fit.model).orderBy("bin").collect()])
    truth = np.arange(400) // 50 % 2
    assert max((states == truth).mean(), (states != truth).mean()) > 0.97


def test_poisson_symbol_and_alphabets(spark):
    values = [0.0, 0.5, 1.0, 5.0, 9.0, 12.0, 20.0, 40.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for mean, bias, limit in ((9.0, 0.2, 0.01), (0.4, 0.0, 0.1), (9.0, 0.0, 0.9)):
        pmf = lambda k, m=mean: math.exp(k * math.log(m) - m - math.lgamma(k + 1))
        got = [r[0] for r in df.select(D.poisson_symbol(df.v, mean, bias, limit)).collect()]
        assert got == [int(v > 0 and pmf(math.floor(v)) < limit * (1 - bias)) for v in values]
    rng = np.random.default_rng(7)
    drawn = {"exponential": rng.exponential(5, 1500), "empirical": np.repeat([1.0, 2.0, 500.0, 501.0], 300), "poisson_zero": rng.poisson(30, 1500) * (rng.random(1500) < 0.5)}
    for kind, x in drawn.items():
        made = D.fit_alphabet(spark.createDataFrame([(float(v),) for v in x], "v double"), "v")
        assert made.kind.startswith(kind.split("_")[0]), (kind, made)


def test_wide_filters_and_levels(spark):
    values = np.random.default_rng(8).normal(size=16)
    signal = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "chrom string, bin long, value double")
    r3 = math.sqrt(3)
    low = [(1 + r3) / (4 * math.sqrt(2)), (3 + r3) / (4 * math.sqrt(2)), (3 - r3) / (4 * math.sqrt(2)), (1 - r3) / (4 * math.sqrt(2))]
    high = [low[3], -low[2], low[1], -low[0]]
    got = {r.idx: (r.approx, r.detail) for r in W.dwt(signal, (low, high), 1).collect()}
    expected = {i: (sum(low[t] * values[(2 * i + t) % 16] for t in range(4)), sum(high[t] * values[(2 * i + t) % 16] for t in range(4))) for i in range(8)}
    assert all(got[i] == pytest.approx(expected[i]) for i in range(8))
    model = W.TreeModel([0.7, 0.3], [[0.8, 0.2], [0.3, 0.7]], [0.0, 1.5], [1.0, 0.7], {2: ([5.0, -5.0], [1.0, 2.0])})
    assert model.level_emission(2) == ([5.0, -5.0], [1.0, 2.0]) and model.level_emission(1) == (model.means, model.deviations)
    tree = spark.createDataFrame([("c", 1, 0, 0.2), ("c", 1, 1, 1.0), ("c", 2, 0, 4.8)], "chrom string, level int, idx long, detail double")
    n = lambda x, m, s: math.exp(-((x - m) ** 2) / (2 * s * s)) / s
    weight = [model.root[s] * n(4.8, *((5.0, 1.0), (-5.0, 2.0))[s]) * math.prod(sum(model.transition[s][j] * n(x, (0.0, 1.5)[j], (1.0, 0.7)[j]) for j in (0, 1)) for x in (0.2, 1.0)) for s in (0, 1)]
    top = {(r.level, r.idx): r.gamma for r in W.tree_posterior(tree, model).collect()}[2, 0]
    assert top[1] == pytest.approx(weight[1] / sum(weight))


@pytest.mark.parametrize("tier", [1, 3, 12])
def test_pyramid_by_bands(spark, monkeypatch, tier):
    monkeypatch.setattr(W, "TIER", tier)
    values = [float(v) for v in np.random.default_rng(9).normal(size=29)]
    signal = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "chrom string, bin long, value double").repartition(3)
    for filters in (W.MEAN, W.HAAR):
        got = {r.bin: r.value for r in W.idwt(W.dwt(signal, filters), filters).collect()}
        assert got == pytest.approx({i: values[i] if i < 29 else 0.0 for i in range(32)})


def test_estimators(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(c, i, float(rng.exponential(30 if i // 30 % 2 else 1))) for c in ("a", "b") for i in range(240)]
    signal, root = spark.createDataFrame(rows, "chrom string, bin long, value double"), f"file://{tmp_path}/models"
    wide = signal.selectExpr("chrom", "bin", "array(value, value * 2 + bin % 3) x")
    assert T.saved_models(spark, root) == []
    with pytest.raises(ValueError):
        T.Segmenter(T.DiscreteStrategy(), 1.5)
    strategies = [T.DiscreteStrategy(), T.NormalStrategy(H.HmmModel([0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], E.Normal([0.5, 3.0], [1.0, 1.0]))), T.ChannelsStrategy(2, 2), T.ChannelSymbolsStrategy(2)]
    for s in strategies:
        data = signal if s.name in ("Discrete", "Normal") else wide
        made = T.Segmenter(s, 2)
        made.fit(data, em.Iterations(2), ["a"])
        states = sorted(map(tuple, made.classify(data).collect()))
        assert len(states) == 240 and s.n_states == 2 and len(s.state_names) == len(s.state_colors) == 2
        made.save(spark, root)
        with pytest.raises(Exception, match="exists"):
            made.save(spark, root)
        made.save(spark, root, "overwrite")
        assert sorted(map(tuple, T.Segmenter.load(spark, root, made.name).classify(data).collect())) == states
    assert T.saved_models(spark, root) == sorted(["Discrete2", "Normal2", "Channels2", "ChannelSymbols2"])
    made.publish(made.classify(wide), f"file://{tmp_path}/bed", 100)
    assert spark.read.csv(f"file://{tmp_path}/bed", sep="\t").count() == S.runs(made.classify(wide)).count()
    assert made.strategy.posterior(made.at_resolution(wide)).count() == 240


def test_wig_headers_over_blocks_and_ingestion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WIG_BLOCK", 2)
    (tmp_path / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "one.wig").write_text("track x\nvariableStep chrom=c1 span=5\n1 2\n11 3\n21 4\n31 5\nvariableStep chrom=c2\n1 7\n")
    (tmp_path / "raw" / "two.filtered-density.wig").write_text("variableStep chrom=c1\n1 9\n")
    (tmp_path / "raw" / "deep" / "three.bedGraph").write_text("track y\nc1\t0\t20\t1.5\nc1\t20\t30\t2\n")
    root, store = f"file://{tmp_path}/raw", f"file://{tmp_path}/store"
    got = sorted(map(tuple, readers.read_wig(spark, f"{root}/one.wig").collect()))
    assert got == [("c1", 0, 5, 2.0), ("c1", 10, 15, 3.0), ("c1", 20, 25, 4.0), ("c1", 30, 35, 5.0), ("c2", 0, 1, 7.0)]
    assert sorted(r.name for r in readers.list_files(spark, root).collect()) == ["deep/three.bedGraph", "one.wig", "two.filtered-density.wig"]
    pairs = {r.source.rsplit("/", 1)[-1]: r.target for r in readers.transform_pairs(spark, root, "/out", "*.bedGraph").collect()}
    assert pairs == {"three.bedGraph": "/out/deep/three"}
    assert readers.ingest(spark, root, store, 10, "wig") == ["one"]
    assert readers.ingest(spark, root, store, 10) == ["three"]
    assert readers.ingest(spark, root, store, 10) == []
    rows = sorted((r.name, r.chrom, r.bin, r.value) for r in readers.load_signal(spark, store, ["c1"]).collect())
    assert rows == [("one", "c1", 0, 2.0), ("one", "c1", 1, 3.0), ("one", "c1", 2, 4.0), ("one", "c1", 3, 5.0), ("three", "c1", 0, 1.5), ("three", "c1", 1, 1.5), ("three", "c1", 2, 2.0)]


def test_permutations_count_genes_of_any_shape(spark):
    regions = spark.createDataFrame([("c", 0, 3, 0), ("c", 3, 2, 1), ("c", 5, 1, 0), ("c", 6, 4, 1), ("d", 0, 10, 1)], "chrom string, start long, length long, state int")
    rows = [("g1", 1, 29), ("g1", 31, 49), ("g2", 30, 50), ("g2", 30, 50), ("g3", 25, 45), ("g3", 22, 41), (None, 0, 100), ("g4", 59, 61), ("g5", 60, 60), ("g6", 99, 120), ("g7", 20, 40)]
    genes = spark.createDataFrame([(g, "c", a, b) for g, a, b in rows], "gene string, chrom string, start long, end long")
    points = C.shuffled_boundaries(regions, 30, 10, 1).collect()
    count = lambda at: len({g for g, a, b in rows if g and any(a < p < b for p in at)})
    observed = count({30, 50, 60})
    more = sum(count({p.pos for p in points if p.perm == i and p.chrom == "c"}) > observed for i in range(30)) / 30
    for bucket in (16, 1000):
        got = {r.chrom: (r.observed, round(r.score, 9)) for r in C.permutation_test(regions, genes, 30, 10, 1, bucket).collect()}
        assert got == {"c": (observed, round(more, 9)), "d": (0, 0.0)}
    assert C.gene_classes(genes.limit(0), 10).count() == 0


def test_points_and_reports(spark):
    points = [("g", 1, 0.5, 10.0), ("g", 2, 0.55, 10.5), ("g", 3, 0.55, 20.0), ("h", 4, 0.5, 10.0)]
    kept = C.drop_near_points(spark.createDataFrame(points, "group string, id int, x double, y double"))
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]
    model = H.default_discrete()
    assert model.n_alphabet == 4 and "state 1" in str(model)
    assert "closed" in writers.states_html(model, ["closed", "open"]) and writers.html_list(["a<"]) == "<ol><li>a&lt;</li></ol>"
    assert writers.description_html(methods="m", credits="") == "<h2>Methods</h2><p>m</p>"
    assert "chr1" in writers.model_readme("n", 20, model, ["chr1"], [-1.0])
    meta = spark.createDataFrame([("a.bw", "x y", "l")], "file string, cell string, lab string")
    got = [r.stanza for r in writers.composite_tracks(meta, "p", "Label", ["cell", "lab"], "http://h/").collect()]
    assert "compositeTrack on" in got[0] and "subGroup1 cell cell x_y=x_y" in got[0]
    assert "track a\n" in got[1] and "subGroups cell=x_y lab=l" in got[1] and "bigDataUrl http://h/a.bw" in got[1]
