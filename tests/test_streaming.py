import datetime as dt

from sigseg.operators import hmm as H
from sigseg.streaming import online


def test_filter_equals_batch(spark, tmp_path):
    model = H.default_discrete()
    obs = [0, 0, 2, 2, 1, 3, 0, 0]
    data = spark.createDataFrame([("c", i, o) for i, o in enumerate(obs)], "chrom string, bin long, obs int")
    for part in (data.filter("bin < 5"), data.filter("bin >= 5")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.online_filter(stream, model).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.bin: round(r.p[1], 9) for r in spark.table("filtered").collect()}
    expected = {r.bin: round(r.gamma[1], 9) for r in H.posterior(H.pack(data, chunk=3), model, "filter").collect()}
    assert got == expected


def test_bins_close_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("c", start + dt.timedelta(minutes=30 * i), 1.0) for i in range(20)]
    spark.createDataFrame(rows, "chrom string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chrom string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = online.closed_bins(stream).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("closed").collect()
    assert got
    assert all(r.n == 2 for r in got)
    assert max(r.start for r in got) < start + dt.timedelta(hours=8)
