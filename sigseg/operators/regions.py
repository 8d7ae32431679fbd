"""Regions (runs of equal state) and what is measured on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that one row of the region index covers.
SPAN = 256


def with_region(signal: DataFrame, regions: DataFrame) -> DataFrame:
    """``signal`` with the ``region`` and ``state`` of each bin: an equi-join on blocks of bins, rechecked."""
    end = F.col("start") + F.col("length") - 1
    index = regions.withColumn("block", F.explode(F.sequence(F.expr(f"start div {SPAN}"), F.floor(end / SPAN))))
    index = index.select(F.col("chrom").alias("chrom"), "block", "region", "state", F.col("start").alias("r_start"), end.alias("r_end"))
    keyed = signal.withColumn("block", F.expr(f"bin div {SPAN}"))
    return keyed.join(index, ["chrom", "block"]).filter("bin between r_start and r_end").drop("block", "r_start", "r_end")


def average_signal(regions: DataFrame, signal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the signal over each region; bins beyond the signal count as 0."""
    sums = with_region(signal, regions).groupBy("chrom", "region", *by).agg(F.sum("value").alias("total"))
    return sums.join(regions.select("chrom", "region", "length"), ["chrom", "region"]).select("chrom", "region", *by, (F.col("total") / F.col("length")).alias("value"))


def length_stats(regions: DataFrame) -> DataFrame:
    """Number, mean, population deviation, longest and shortest of each state's regions."""
    n = F.col("length").cast("double")
    return regions.groupBy("state").agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.max("length").alias("max"), F.min("length").alias("min"))


def length_histogram(regions: DataFrame, bin_size: int, low: float = 2.5, high: float = 6.2, step: float = 0.03) -> DataFrame:
    """Regions by log10 of their length in positions, in equal steps."""
    x = F.round(F.log10(F.col("length") * bin_size), 9)
    place = F.floor((x - low) / step).cast("long")
    return regions.filter((x >= low) & (x < high)).groupBy("state", place.alias("slot")).agg(F.count("*").alias("n"))


def range_join(points: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """Points (chrom, pos, ...) with each interval (chrom, start, end, ...) that has start < pos < end.

    Intervals are copied to each bucket of positions that they touch, so this
    is an equi-join with a recheck and no pair of far rows is looked at.
    """
    cut = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    held = points.withColumn("bucket", F.floor(F.col("pos") / bucket))
    return held.join(cut, ["chrom", "bucket"]).filter("start < pos and pos < end").drop("bucket")


def broken_genes(boundaries: DataFrame, genes: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """chrom, n: genes (chrom, gene, start, end) with a boundary (chrom, pos) strictly inside."""
    hit = range_join(boundaries.select("chrom", "pos"), genes.select("chrom", "gene", "start", "end"), bucket)
    return hit.groupBy("chrom").agg(F.countDistinct("gene").alias("n"))


def near_boundary(regions: DataFrame, peaks: DataFrame, bin_size: int, share: float = 0.05, bucket: int = 1 << 16) -> DataFrame:
    """chrom, region, has_peak: a peak's midpoint lies within ``share`` of the region's length of its start."""
    reach = F.col("length") * bin_size * share
    at = F.col("start") * bin_size
    windows = regions.select("chrom", "region", (at - reach).alias("start"), (at + reach).alias("end"))
    mid = peaks.select(F.col("chrom").alias("chrom"), ((F.col("start") + F.col("end")) / 2).alias("pos"))
    found = range_join(mid, windows, bucket).select("chrom", "region").distinct().withColumn("hit", F.lit(True))
    return regions.select("chrom", "region").join(found, ["chrom", "region"], "left").select("chrom", "region", F.coalesce("hit", F.lit(False)).alias("has_peak"))


def nearest_start(peaks: DataFrame, regions: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Each peak (chrom, id, pos) with the nearest region start (chrom, start, length); on a tie the one to the right.

    Positions go by buckets. Within a bucket, running last values over both
    directions give the neighbours; what lies beyond comes from the table of
    buckets, one row for each that holds a region start.
    """
    place = lambda x: F.floor(x / bucket).cast("long")
    starts = regions.select("chrom", F.col("start").cast("double").alias("pos"), F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).alias("r")).withColumn("bucket", place(F.col("pos")))
    ends = starts.groupBy("chrom", "bucket").agg(F.max("r").alias("last"), F.min("r").alias("first"))
    asked = peaks.select("chrom", place(F.col("pos")).alias("bucket")).distinct()
    table = ends.join(asked, ["chrom", "bucket"], "full")
    up, down = Window.partitionBy("chrom").orderBy("bucket"), Window.partitionBy("chrom").orderBy(F.desc("bucket"))
    before = F.last("last", True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("first", True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    table = table.select("chrom", "bucket", before.alias("before"), after.alias("after"))
    both = peaks.select("chrom", "id", "pos", place(F.col("pos")).alias("bucket"), F.lit(None).cast("struct<start:bigint,length:bigint>").alias("r"))
    both = both.unionByName(starts.select("chrom", F.lit(None).cast("long").alias("id"), "pos", "bucket", "r"))
    here = Window.partitionBy("chrom", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    back = F.last("r", True).over(here.orderBy("pos", F.col("id").isNotNull()))
    ahead = F.last("r", True).over(here.orderBy(F.desc("pos"), F.col("id").isNotNull().cast("int")))
    near = both.withColumn("left", back).withColumn("right", ahead).filter("id is not null").join(table, ["chrom", "bucket"])
    near = near.withColumn("left", F.coalesce("left", "before")).withColumn("right", F.coalesce("right", "after"))
    to_left, to_right = F.col("pos") - F.col("left.start"), F.col("right.start") - F.col("pos")
    pick = F.when(F.col("left").isNull() | (to_right <= to_left), F.col("right")).otherwise(F.col("left"))
    return near.withColumn("r", pick).select("chrom", "id", "pos", F.col("r.start").alias("start"), F.col("r.length").alias("length"))


#: Features of a region by id, each a function of (regions, signal, bin_size) that gives chrom, region and one column.
FEATURES: dict[int, tuple[str, Callable[[DataFrame, DataFrame, int], DataFrame]]] = {
    0: ("state", lambda r, s, b: r.select("chrom", "region", "state")),
    1: ("start", lambda r, s, b: r.select("chrom", "region", (F.col("start") * b).alias("start"))),
    2: ("length", lambda r, s, b: r.select("chrom", "region", (F.col("length") * b).alias("length"))),
    3: ("average_signal", lambda r, s, b: average_signal(r, s).withColumnRenamed("value", "average_signal")),
    4: ("largest_signal", lambda r, s, b: with_region(s, r).groupBy("chrom", "region").agg(F.max("value").alias("largest_signal"))),
    5: ("log_length", lambda r, s, b: r.select("chrom", "region", F.log10(F.col("length") * b).alias("log_length"))),
}


def feature_labels(ids: list[int]) -> list[str]:
    """Names of features."""
    return [FEATURES[i][0] for i in ids]


def feature_matrix(regions: DataFrame, signal: DataFrame, ids: list[int], bin_size: int = 1) -> DataFrame:
    """chrom, region and the asked features; what is not asked for is not computed."""
    out = regions.select("chrom", "region")
    for i in ids:
        out = out.join(FEATURES[i][1](regions, signal, bin_size), ["chrom", "region"], "left")
    return out.select("chrom", "region", *feature_labels(ids))
