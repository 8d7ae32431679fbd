import numpy as np
import pytest
from pyspark.sql import functions as F

from sigseg.functions import emissions as E
from sigseg.operators import discretize as D
from sigseg.operators import multichannel as M
from sigseg.operators import regions as R
from sigseg.operators import signal as S
from sigseg.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def seg(spark, text, chrom="c"):
    return spark.createDataFrame([(chrom, i, int(s)) for i, s in enumerate(text)], "chrom string, bin long, state int")


@pytest.mark.parametrize("text", ["0000", "1111", "0101", "1100", "0011", "1", "001110110"])
def test_runs(spark, text):
    import itertools

    expected, at = [], 0
    for i, (k, g) in enumerate(itertools.groupby(text)):
        n = len(list(g))
        expected.append(("c", i, at, n, int(k)))
        at += n
    assert rows(S.runs(seg(spark, text))) == expected


def test_a_gap_ends_a_run(spark):
    df = spark.createDataFrame([("c", 0, 1), ("c", 1, 1), ("c", 3, 1)], "chrom string, bin long, state int")
    assert [(r.start, r.length) for r in S.runs(df).orderBy("start").collect()] == [(0, 2), (3, 1)]


def test_rasterize_keeps_mass(spark):
    cut = [("c", 3, 7, 2.0), ("c", 8, 12, 1.0), ("c", 10, 20, 4.0), ("c", 15, 47, 1.0), ("c", 20, 20, 9.0)]
    df = spark.createDataFrame(cut, "chrom string, start long, end long, score double")
    got = {r.bin: r.value for r in S.rasterize(df, 10).collect()}
    assert sum(got.values()) * 10 == pytest.approx(sum((e - s) * v for _, s, e, v in cut))
    assert got[0] == pytest.approx((4 * 2 + 2 * 1) / 10)
    assert {r.bin: r.value for r in S.rasterize(df, 10, "assign").collect()}[1] == 1.0
    assert rows(S.clip(df, 15).select("start", "end")) == [(3, 7), (8, 12), (10, 15)]


def test_resample_grid_and_stack(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(7)] + [("d", 1, 5.0)], "chrom string, bin long, value double")
    assert rows(S.resample(df, 3)) == [("c", 0, 3.0), ("c", 1, 12.0)]
    assert rows(S.to_grid(df.filter("chrom = 'd'"), S.bins_of(df).filter("chrom = 'd'"))) == [("d", 0, 0.0), ("d", 1, 5.0)]
    with pytest.raises(ValueError, match="whole"):
        S.resample(df, 0)
    wide = S.stack(df.withColumn("track", F.lit(1)), [1, 2])
    assert rows(wide.filter("chrom = 'd'")) == [("d", 0, 0.0, 0.0), ("d", 1, 5.0, 0.0)]
    assert S.runs(df.limit(0), "value").count() == 0


def test_symbols(spark):
    values = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 1, 2, 3, 10]], "value double")
    cuts = D.percentiles(values, "value", [50, 90])
    assert cuts == pytest.approx(np.percentile([0, 0, 0, 1, 2, 3, 10], [50, 90]))
    assert [r.s for r in values.select(D.above(F.col("value"), cuts).alias("s")).collect()] == [int(v > cuts[0]) + int(v > cuts[1]) for v in [0, 0, 0, 1, 2, 3, 10]]
    packed = spark.range(40).select((F.col("id") % 5).alias("a"), (F.col("id") % 3).alias("b"))
    both = packed.select("a", "b", D.pack([F.col("a"), F.col("b")], [5, 3]).alias("p"))
    for r in both.select("a", "b", *[c.alias(f"u{i}") for i, c in enumerate(D.unpack(F.col("p"), [5, 3]))]).collect():
        assert (r.a, r.b) == (r.u0, r.u1)
    assert D.alphabet_size([5, 3]) == 32


def test_distribution_is_recognised(spark):
    rng = np.random.default_rng(1)
    draw = spark.createDataFrame([(float(v),) for v in rng.exponential(30, 3000)], "value double")
    assert D.select_distribution(draw, "value").startswith("exponential")


def test_nearest_prefers_the_right_on_ties(spark):
    peaks = spark.createDataFrame([("c", 1, 5.0), ("c", 2, 11.0), ("c", 3, -4.0), ("c", 4, 10.0)], "chrom string, id long, pos double")
    starts = spark.createDataFrame([("c", 0, 3), ("c", 10, 4)], "chrom string, start long, length long")
    assert {r.id: r.start for r in R.nearest_start(peaks, starts).collect()} == {1: 10, 2: 10, 3: 0, 4: 10}


def test_emission_columns_equal_arrays(spark):
    x = [0.0, 0.5, 2.0, 50.0]
    df = spark.createDataFrame([(v, [v, v + 1]) for v in x], "x double, v array<double>")
    for e in (E.Normal([0.0, 1.0], [1.0, 2.0]), E.Mixture([[0.3, 0.7]], [[0.0, 1.0]], [[1.0, 0.5]])):
        got = [list(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(e.columns(F.col("x")))]).collect()]
        assert np.array(got) == pytest.approx(e.densities(np.array(x)))
    e = E.MultivariateNormal([[0.0, 1.0]], [[[2.0, 0.5], [0.5, 1.0]]])
    got = [r[0] for r in df.select(*e.columns(F.col("v"))).collect()]
    assert got == pytest.approx(e.densities(np.array([[v, v + 1] for v in x]))[:, 0])
    with pytest.raises(ValueError, match="sum to 1"):
        E.Mixture([[0.3, 0.3]], [[0.0, 1.0]], [[1.0, 0.5]])


def test_pca_recovers(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 4)) + 5
    df = spark.createDataFrame([("c", i, row.tolist()) for i, row in enumerate(data)], "chrom string, bin long, x array<double>")
    pca = M.fit_pca(df, min_energy=0.999)
    w = np.array(pca.components)
    assert len(w) == 2
    assert w @ w.T == pytest.approx(np.eye(2))
    back = [r.y for r in df.select(pca.recover(pca.transform(F.col("x"))).alias("y"), "bin").orderBy("bin").collect()]
    assert np.array(back) == pytest.approx(data)


def test_text_formats_round_trip(spark, tmp_path):
    (tmp_path / "a.wig").write_text("track type=wiggle_0\nvariableStep chrom=c span=10\n1\t3\n11\t4\nvariableStep chrom=d span=10\n21\t5\n")
    steps = readers.read_wig(spark, f"file://{tmp_path}/a.wig")
    assert rows(steps) == [("c", 0, 10, 3.0), ("c", 10, 20, 4.0), ("d", 20, 30, 5.0)]
    assert rows(readers.wig_bins(steps, 20)) == [("c", 0, 7.0), ("d", 1, 5.0)]
    signal = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 1.0), ("c", 2, 0.0)], "chrom string, bin long, value double")
    writers.write_tsv(writers.bedgraph_rows(signal, 20), f"file://{tmp_path}/bg")
    back = readers.read_bedgraph(spark, f"file://{tmp_path}/bg")
    assert rows(back) == [("c", 0, 40, 1.0), ("c", 40, 60, 0.0)]
    assert rows(S.rasterize(back, 20)) == rows(signal)
    readers.save_signal(signal, f"file://{tmp_path}/store")
    assert rows(readers.load_signal(spark, f"file://{tmp_path}/store", ["c"]).select("chrom", "bin", "value")) == rows(signal)
    assert readers.load_signal(spark, f"file://{tmp_path}/store", ["c1"]).count() == 0
    np.savez(tmp_path / "x.npz", c=np.array([1.0, 2.0]))
    assert rows(readers.import_npz(spark, f"file://{tmp_path}/x.npz")) == [("c", 0, 1.0), ("c", 1, 2.0)]
    (tmp_path / "genes").write_text("g1\tc\t-\t5\t9\t5\t9\t1\t5,\t9,\tp\ta\n")
    assert rows(readers.read_genes(spark, f"file://{tmp_path}/genes"))[0][:5] == ("g1", "c", -1, 5, 9)
    (tmp_path / "peaks").write_text("c\t5\t9\t.\t0\t.\t1.5\t20\t-1\n")
    assert rows(readers.read_broad_peaks(spark, f"file://{tmp_path}/peaks")) == [("c", 5, 9, 20.0)]
    (tmp_path / "sizes").write_text("c\t100\n")
    assert rows(S.sizes_in_bins(readers.read_sizes(spark, f"file://{tmp_path}/sizes"), 30)) == [("c", 3)]
    files = spark.createDataFrame([("lung_fetal-h3k4",), ("lung-h3k4",)], "name string")
    assert readers.available_tracks(files, "fetal_lung", ["h3k4"]) == ["lung_fetal-h3k4"]


def test_reports():
    from sigseg.operators.hmm import default_discrete

    model = default_discrete()
    assert len(writers.model_summary(model)) == 8
    assert "<table>" in writers.model_html(model)
    assert "trackDb" in writers.hub_files("h", "hg19", "x@y", [writers.track_stanza("t", "bed 9", "u", "label")])["genomes.txt"]
