"""Scores of segmentations, and random segmentations to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigseg.operators.regions import range_join


def consistency(samples: DataFrame, low: float = 0.2, high: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """by, sample, score: share of the decided bins at which a sample agrees.

    A bin (chrom, bin) is decided if at most ``low`` or at least ``high`` of
    the samples (chrom, bin, sample, state in 0, 1) are open there.
    """
    place = [*by, "chrom", "bin"]
    mean = samples.groupBy(*place).agg(F.avg("state").alias("m"))
    decided = mean.filter((F.col("m") <= low) | (F.col("m") >= high)).select(*place, (F.col("m") >= high).cast("int").alias("truth"))
    return samples.join(decided, place).groupBy(*by, "sample").agg(F.avg((F.col("state") == F.col("truth")).cast("double")).alias("score"))


def enrichment(segmentation: DataFrame, signal: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Mean signal of open bins over that of closed bins; null where a side is empty.

    Over a mean of 0 it is infinite with the sign of the other mean, or NaN if that is 0 too.
    """
    both = signal.join(segmentation.select("chrom", "bin", "state"), ["chrom", "bin"])
    inside = F.avg(F.when(F.col("state") == 1, F.col("value")))
    outside = F.avg(F.when(F.col("state") == 0, F.col("value")))
    return both.groupBy(*by).agg(ratio(inside, outside).alias("score"))


def ratio(inside: Column, outside: Column) -> Column:
    """The quotient as ``enrichment`` defines it."""
    over_zero = F.when(inside == 0, F.lit(float("nan"))).otherwise(F.signum(inside) * F.lit(float("inf")))
    return F.when(outside == 0, over_zero).otherwise(F.try_divide(inside, outside))


def peak_gaps(peaks: DataFrame) -> DataFrame:
    """chrom, id, pos (midpoint), gap to the next midpoint; the last peak of a chromosome has none."""
    mid = peaks.select("chrom", "id", ((F.col("start") + F.col("end")) / 2).alias("pos"))
    return mid.withColumn("gap", F.lead("pos").over(Window.partitionBy("chrom").orderBy("pos", "id")) - F.col("pos"))


def gap_agreement(nearest: DataFrame, gaps: DataFrame, tolerance: float = 0.1, center: float = 0.0) -> DataFrame:
    """chrom, score: share of the regions met whose length agrees with the gap of their nearest peak.

    ``nearest``: peaks with start and length of the nearest region. Of several
    peaks, a region keeps the closest, the first by id on a tie. They agree if
    the log of length over gap is within ``tolerance`` of ``center``.
    """
    joined = nearest.join(gaps.select("chrom", "id", "gap"), ["chrom", "id"]).filter("gap > 0 and length > 0")
    best = Window.partitionBy("chrom", "start").orderBy(F.abs(F.col("pos") - F.col("start")), "id")
    kept = joined.withColumn("r", F.row_number().over(best)).filter("r = 1")
    near = F.abs(F.abs(F.log(F.col("length") / F.col("gap"))) - center) < tolerance
    return kept.groupBy("chrom").agg(F.avg(near.cast("double")).alias("score"))


def shuffled_boundaries(regions: DataFrame, permutations: int, bin_size: int, seed: int = 1) -> DataFrame:
    """perm, chrom, pos: boundaries after open and closed lengths have been shuffled each among themselves.

    The order comes from a hash of seed, permutation and region. Lengths of
    both kinds alternate as they did, beginning with the kind that began.
    """
    first = regions.filter("start = 0").select("chrom", F.col("state").alias("opening"))
    drawn = regions.join(first, "chrom").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    order = Window.partitionBy("perm", "chrom", "state").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "perm", "chrom", "start")))
    turn = 2 * (F.row_number().over(order) - 1) + (F.col("state") != F.col("opening")).cast("int")
    along = Window.partitionBy("perm", "chrom").orderBy("turn")
    placed = drawn.withColumn("turn", turn).withColumn("pos", F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, 0)) * bin_size)
    last = F.max("turn").over(Window.partitionBy("perm", "chrom"))
    return placed.withColumn("last", last).filter("turn < last").select("perm", "chrom", "pos")


def gene_classes(genes: DataFrame, bin_size: int) -> DataFrame:
    """chrom, gene, low, high, start, end, weight: genes for boundaries at multiples of ``bin_size``.

    Such boundaries break a gene if and only if they break what it widens to on
    their grid, so all genes that widen alike are one row (low, high), with their
    number as ``weight``. Only a gene of several unlike intervals keeps a row for
    each, under its name. Genes that no multiple lies within are left out.
    """
    start, end = (F.floor(F.col("start") / bin_size) * bin_size).alias("start"), (F.ceil(F.col("end") / bin_size) * bin_size).alias("end")
    wide = genes.filter("gene is not null").select("chrom", "gene", start, end).filter(F.col("end") - F.col("start") > bin_size)
    per = wide.groupBy("chrom", "gene").agg(F.min("start").alias("low"), F.max("start").alias("low_2"), F.min("end").alias("high"), F.max("end").alias("high_2"))
    alike, unlike = per.filter("low = low_2 and high = high_2"), per.filter("low < low_2 or high < high_2")
    nothing = F.lit(None).cast(genes.schema["gene"].dataType).alias("gene")
    one = alike.groupBy("chrom", "low", "high").agg(F.count("*").alias("weight")).select("chrom", nothing, "low", "high", F.col("low").alias("start"), F.col("high").alias("end"), "weight")
    none = F.lit(None).cast("long")
    many = wide.join(unlike.select("chrom", "gene"), ["chrom", "gene"], "left_semi").distinct()
    return one.unionByName(many.select("chrom", "gene", none.alias("low"), none.alias("high"), "start", "end", F.lit(1).cast("long").alias("weight")))


def permutation_test(regions: DataFrame, genes: DataFrame, permutations: int, bin_size: int, seed: int = 1, bucket: int = 1 << 16) -> DataFrame:
    """chrom, observed, score: share of the permutations that break more genes than the segmentation does."""
    real = regions.filter("start > 0").select(F.lit(-1).alias("perm"), "chrom", (F.col("start") * bin_size).alias("pos"))
    points = real.unionByName(shuffled_boundaries(regions, permutations, bin_size, seed))
    broken = range_join(points, gene_classes(genes, bin_size), bucket).select("chrom", "perm", "gene", "low", "high", "weight").distinct()
    hit = broken.groupBy("chrom", "perm").agg(F.sum("weight").alias("n"))
    seen = hit.filter("perm = -1").select("chrom", F.col("n").alias("observed"))
    more = hit.filter("perm >= 0").join(seen, "chrom", "left").filter(F.col("n") > F.coalesce("observed", F.lit(0))).groupBy("chrom").agg((F.count("*") / permutations).alias("score"))
    chroms = regions.select("chrom").distinct()
    return chroms.join(seen, "chrom", "left").join(more, "chrom", "left").select("chrom", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("score", F.lit(0.0)).alias("score"))


def drop_near_points(points: DataFrame, near: float = 0.1, ratio: float = 0.9) -> DataFrame:
    """Grid points (group, id, x, y) without those that an earlier one of the group nearly equals: x within ``near`` and y ratio of at least ``ratio``."""
    a, b = points.alias("a"), points.alias("b")
    same = (F.col("a.group") == F.col("b.group")) & (F.col("b.id") < F.col("a.id"))
    close = (F.abs(F.col("a.x") - F.col("b.x")) < near) & (F.least("a.y", "b.y") >= ratio * F.greatest("a.y", "b.y"))
    return a.join(b, same & close, "left_anti").select("a.*")


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the first in order of equal ones."""
    return rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(1)
