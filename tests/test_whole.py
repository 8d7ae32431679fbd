"""Queries take all of the signal, all intervals and late events."""

import hashlib
from collections import defaultdict
from datetime import datetime
from itertools import accumulate

import pytest

from sigseg.plans import catalogue as Q
from sigseg.plans import views as V

SF = "/root/testdata/sf0.001"


def test_wavelet_and_tree_queries_take_the_whole_signal(spark):
    bins = {(r.chrom, r.bin): r.value for r in V.sig_hour(spark, SF).collect()}
    got = {(r.chrom, r.bin): r.value for r in Q.wav_idwt(spark, SF).collect()}
    assert got == pytest.approx(bins, abs=1e-6)
    assert {(r.chrom, r.bin) for r in Q.wav_denoise(spark, SF).collect()} == set(bins)
    assert {(r.chrom, r.bin) for r in Q.hmt_level_seg(spark, SF).collect()} == {(c, b // 8) for c, b in bins}
    for f in (Q.hmt_posterior, Q.hmt_viterbi, Q.wav_dwt):
        assert {r.level for r in f(spark, SF).select("level").distinct().collect()} == set(range(1, 11))


def events(spark, path, *hours):
    rows = [(i, 1, "click", datetime.fromisoformat(h), 2.0) for i, h in enumerate(hours)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_late_events_lengthen_the_grid(spark, tmp_path):
    sf = events(spark, tmp_path / "late", "2024-01-01T00:30:00", "2024-02-05T10:30:00")
    last = 35 * 24 + 10
    for rows, n in ((V.sig_hour(spark, sf), 1), (V.mc_hour(spark, sf), 4)):
        assert rows.count() == (last + 1) * n
        assert rows.filter("value > 0").count() == 2
    assert V.intervals(spark, sf).filter("start < end").count() == 2


def test_early_events_are_an_error(spark, tmp_path):
    sf = events(spark, tmp_path / "early", "2023-12-31T23:30:00")
    with pytest.raises(Exception, match="has no bin"):
        V.sig_hour(spark, sf).collect()


def broken(genes, points):
    return {g for g, a, b in genes if any(a < p < b for p in points)}


def test_gene_scores_take_all_intervals_and_500_permutations(spark):
    genes, regions = defaultdict(list), defaultdict(list)
    for r in V.intervals(spark, SF).collect():
        genes[r.chrom].append((r.id, r.start, r.end))
    for r in Q.naive_regions(spark, SF).collect():
        regions[r.chrom].append((r.start, r.length, r.state))
    observed, score = {}, {}
    for chrom, rows in regions.items():
        rows.sort()
        observed[chrom] = len(broken(genes[chrom], {s * 3600 for s, _, _ in rows[1:]}))
        more = 0
        for perm in range(500):
            key = lambda r: hashlib.md5(f"1|{perm}|{chrom}|{r[0]}".encode()).hexdigest()  # noqa: B023, E731
            kinds = [sorted((r for r in rows if (r[2] == rows[0][2]) == opening), key=key) for opening in (True, False)]
            lengths = [kinds[i % 2][i // 2][1] for i in range(len(rows))]
            more += len(broken(genes[chrom], {p * 3600 for p in list(accumulate(lengths))[:-1]})) > observed[chrom]
        score[chrom] = round(more / 500, 6)
    got = {r.chrom: r for r in Q.score_gene_perm_whole(spark, SF).collect()}
    assert {c: r.observed for c, r in got.items()} == observed
    assert {c: r.score for c, r in got.items()} == score
    assert {r.chrom: r.n for r in Q.score_gene_breaks(spark, SF).collect()} == {c: n for c, n in observed.items() if n}
