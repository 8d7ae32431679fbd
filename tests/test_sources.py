"""Many wig files in one plan, merged steps, stores of regions, and filters of more taps there and back."""

import duckdb
import numpy as np
import pytest

from sigseg.operators import wavelet as W
from sigseg.plans import catalogue
from sigseg.sources import readers, segments


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_wig_files_in_one_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WIG_BLOCK", 3)
    (tmp_path / "raw").mkdir()
    for i in range(60):
        (tmp_path / "raw" / f"f{i}.wig").write_text(f"track x\nvariableStep chrom=c{i % 2} span=10\n" + "".join(f"{10 * j + 1} {i + j % 2}\n" for j in range(5)) + "variableStep chrom=d\n7 1\n")
    paths = [f"file://{tmp_path}/raw/f{i}.wig" for i in range(60)]
    few, many = (plan(readers.read_wig_files(spark, p)) for p in (paths[:2], paths))
    assert len(few.splitlines()) == len(many.splitlines())
    got = sorted((r.file.rsplit("/", 1)[-1], r.chrom, r.start, r.end, r.score) for r in readers.read_wig_files(spark, paths).collect())
    expected = [(f"f{i}.wig", f"c{i % 2}", 10 * j, 10 * j + 10, float(i + j % 2)) for i in range(60) for j in range(5)] + [(f"f{i}.wig", "d", 6, 7, 1.0) for i in range(60)]
    assert got == sorted(expected)
    assert len(readers.ingest(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/store", 20, "wig")) == 60
    assert spark.read.parquet(f"{tmp_path}/store").groupBy("name").sum("value").count() == 60
    assert len(readers.wig_to_bedgraph(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/bg")) == 60
    assert readers.wig_to_bedgraph(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/bg") == []
    back = readers.read_bedgraph(spark, f"file://{tmp_path}/bg/name=f3")
    assert sorted(map(tuple, back.collect())) == [("c1", 10 * j, 10 * j + 10, 3.0 + j % 2) for j in range(5)] + [("d", 6, 7, 1.0)]


@pytest.mark.parametrize("name", ["io_wig_store", "io_wig_bedgraph"])
def test_wig_headers_stay_with_their_steps(spark, name):
    """As on large tables: joins that shuffle, whose small partitions are put together."""
    sf, large = "/root/testdata/sf0.01", {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.shuffle.partitions": "40"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    expected = db.sql(catalogue.ORACLE_SQL[name])
    before = {k: spark.conf.get(k, None) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        got = catalogue.QUERIES[name](spark, sf).select(*expected.columns).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted((*r[:-1], round(r[-1], 6)) for r in got) == sorted((*r[:-1], round(r[-1], 6)) for r in expected.fetchall())


def test_merged_steps_cover_what_the_steps_cover(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for _ in range(400):
        at += int(rng.integers(0, 2)) * 5
        rows.append(("a" if at < 1000 else "b", at, at + 5, float(rng.integers(0, 2))))
        at += 5
    df = spark.createDataFrame([*rows, rows[3], ("a", 7, 7, 1.0)], "chrom string, start long, end long, score double").repartition(4)
    expected = []
    for r in rows:
        last = expected[-1] if expected else None
        if last and last[0] == r[0] and last[2] == r[1] and last[3] == r[3]:
            expected[-1] = (*last[:2], r[2], r[3])
        else:
            expected.append(r)
    assert sorted(map(tuple, readers.merge_steps(df).collect())) == sorted(expected)
    assert readers.merge_steps(df.limit(0)).count() == 0


def test_store_of_segmentations(spark, tmp_path):
    path, ddl = f"file://{tmp_path}/seg", "chrom string, region int, start long, length long, state int"
    rows = [(f"chr{c}", r, 10 * r, 10, r % 2) for c in range(5) for r in range(4)]
    segments.save_segmentation(spark.createDataFrame(rows, ddl), path, "liver", "m1", 20)
    segments.save_segmentation(spark.createDataFrame(rows[:4], ddl), path, "heart", "m1", 100)
    segments.save_segmentation(spark.createDataFrame([("chr1", 0, 0, 99, 1)], ddl), path, "liver", "m1", 20)
    got = segments.load_segmentation(spark, path, "liver", "m1", ["chr1", "chr3"])
    assert sorted(map(tuple, got.collect())) == [("chr1", 0, 0, 1980, 1)] + [("chr3", r, 200 * r, 200, r % 2) for r in range(4)]
    text = got._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters")[1]
    assert "cell#" in filters and " IN (" in filters
    assert segments.load_segmentation(spark, path, "heart", "m1").count() == 4
    found = {(r.cell, r.chrom): (r.bin_size, r.regions, r.bins) for r in segments.manifest(spark, path).collect()}
    assert len(found) == 6 and found["liver", "chr1"] == (20, 1, 99) and found["heart", "chr0"] == (100, 4, 40)
    for cell, chroms in (("lung", None), ("liver", ["chr9"])):
        with pytest.raises(ValueError, match="not stored"):
            segments.load_segmentation(spark, path, cell, "m1", chroms)


@pytest.mark.parametrize("n", [1, 2, 8, 33])
def test_four_taps_there_and_back(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(c, i, float(v) * (1 + (c == "b"))) for c in "ab" for i, v in enumerate(x)], "chrom string, bin long, value double")
    for filters in (W.FOUR, tuple([2 * v for v in f] for f in W.FOUR)):
        back = {(r.chrom, r.bin): r.value for r in W.idwt(W.dwt(df, filters), filters).collect()}
        assert all(back.get((c, i), 0.0) == pytest.approx(v * (1 + (c == "b")), abs=1e-9) for c in "ab" for i, v in enumerate(x)) or n == 1


def test_pairs_that_are_not_orthogonal_are_refused():
    assert W.orthogonal_scale(W.FOUR) == pytest.approx(1)
    with pytest.raises(ValueError, match="orthogonal"):
        W.orthogonal_scale(([0.25] * 4, [0.25, -0.25, 0.25, -0.25]))
