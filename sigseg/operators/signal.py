"""Binned signals: rows of (track,) chrom, bin, value.

Bins are explicit; a missing row is a zero that ``to_grid`` fills in. All
operators are DataFrame expressions keyed by (chrom, bin), so a long chromosome
spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a block of the grid.
GRID_BLOCK = 1 << 16
#: Bins of a block in which runs are cut.
RUN_BLOCK = 1 << 13


def grid(sizes: DataFrame, bins: str = "bins") -> DataFrame:
    """chrom, bin for each bin of each chromosome of ``sizes`` (chrom, ``bins``)."""
    blocks = sizes.filter(F.col(bins) > 0).select("chrom", F.col(bins).cast("long").alias("n"), F.explode(F.expr(f"sequence(0L, (cast({bins} as bigint) - 1) div {GRID_BLOCK})")).alias("b"))
    first = F.col("b") * GRID_BLOCK
    return blocks.select("chrom", F.explode(F.sequence(first, F.least(first + GRID_BLOCK, F.col("n")) - 1)).alias("bin"))


def to_grid(signal: DataFrame, sizes: DataFrame, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """``signal`` on all bins of ``sizes``; absent bins are 0, bins beyond the size go."""
    joined = grid(sizes).join(signal, ["chrom", "bin"], "left")
    return joined.select("chrom", "bin", *[F.coalesce(F.col(v), F.lit(0).cast(dict(signal.dtypes)[v])).alias(v) for v in values])


def bins_of(signal: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, bins: one more than the last bin."""
    return signal.groupBy(*keys).agg((F.max("bin") + 1).alias("bins"))


def sizes_in_bins(sizes: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bins from chrom, size in positions; a partial last bin does not count."""
    return sizes.select("chrom", F.expr(f"size div {bin_size}").alias("bins"))


def rasterize(intervals: DataFrame, bin_size: int, mode: str = "sum") -> DataFrame:
    """Half-open intervals (chrom, start, end, score) to bins.

    ``sum``: each bin gets the scores weighted by the share of the bin that
    they cover; overlapping intervals add up. ``assign``: each bin that an
    interval touches takes the score of the last one, by (start, end, score).
    Empty intervals give nothing.
    """
    last = F.expr(f"(end - 1) div {bin_size}")
    cut = intervals.filter("start < end").withColumn("bin", F.explode(F.sequence(F.expr(f"start div {bin_size}"), last)))
    if mode == "assign":
        return cut.groupBy("chrom", "bin").agg(F.max_by("score", F.struct("start", "end", "score")).alias("value"))
    covered = F.least("end", (F.col("bin") + 1) * bin_size) - F.greatest("start", F.col("bin") * bin_size)
    return cut.groupBy("chrom", "bin").agg((F.sum(F.col("score") * covered) / bin_size).alias("value"))


def clip(intervals: DataFrame, size: int) -> DataFrame:
    """Intervals cut at the end of the chromosome."""
    return intervals.filter(F.col("start") < size).withColumn("end", F.least("end", F.lit(size).cast("long")))


def resample(signal: DataFrame, factor: int, how: str = "sum", keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Sums (or means) of ``factor`` adjacent bins; the remainder at the end of a sequence (keys) is dropped."""
    if factor < 1 or factor != int(factor):
        raise ValueError("the factor is a whole number of bins")
    whole = bins_of(signal, keys).select(*keys, F.expr(f"bins div {factor} * {factor}").alias("whole"))
    kept = signal.join(whole, list(keys)).filter("bin < whole")
    total = F.sum("value")
    return kept.groupBy(*keys, F.expr(f"bin div {factor}").alias("bin")).agg((total if how == "sum" else total / factor).alias("value"))


def log_diff(tracks: DataFrame) -> DataFrame:
    """ln(1 + value) less its mean over the tracks at the same position."""
    here = Window.partitionBy("chrom", "bin")
    x = F.log1p("value")
    return tracks.withColumn("value", x - F.avg(x).over(here))


def stack(tracks: DataFrame, names: list) -> DataFrame:
    """chrom, bin and one column for each track; absent values are 0 up to the longest track."""
    wide = tracks.groupBy("chrom", "bin").pivot("track", names).agg(F.sum("value"))
    columns = [str(n) for n in names]
    return to_grid(wide, bins_of(tracks), tuple(columns))


def sample_mean(samples: DataFrame, n_samples: int, keys: tuple[str, ...] = ("chrom", "bin")) -> DataFrame:
    """Mean over samples, absent values counting as 0."""
    return samples.groupBy(*keys).agg((F.sum("value") / n_samples).alias("value"))


def fold_changes(rows: DataFrame, state: str | Column = "state") -> DataFrame:
    """chrom, bin, state where a run of equal states begins; found by a join with the bin before, not by a walk."""
    seg = rows.select("chrom", "bin", (F.col(state) if isinstance(state, str) else state).alias("state"))
    before = seg.select(F.col("chrom").alias("chrom"), (F.col("bin") + 1).alias("bin"), F.col("state").alias("prev"))
    return seg.join(before, ["chrom", "bin"], "left").filter(~F.col("state").eqNullSafe(F.col("prev"))).select("chrom", "bin", "state")


def runs(segmentation: DataFrame, state: str | Column = "state") -> DataFrame:
    """chrom, region, start, length, state of the maximal runs; a gap in the bins ends a run.

    Runs are cut within blocks of RUN_BLOCK bins; only these pieces, one row
    for each run or block, are sorted within a chromosome and put together.
    """
    seg = segmentation.select("chrom", "bin", (F.col(state) if isinstance(state, str) else state).alias("state"), F.expr(f"bin div {RUN_BLOCK}").alias("block"))
    inside = Window.partitionBy("chrom", "block").orderBy("bin")
    same = F.lag("state").over(inside).eqNullSafe(F.col("state")) & (F.lag("bin").over(inside) == F.col("bin") - 1)
    marked = seg.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(inside))
    pieces = marked.groupBy("chrom", "block", "island").agg(F.min("bin").alias("start"), F.count("*").alias("length"), F.first("state").alias("state"))
    along = Window.partitionBy("chrom").orderBy("start")
    joins = F.lag("state").over(along).eqNullSafe(F.col("state")) & (F.lag(F.col("start") + F.col("length")).over(along) == F.col("start"))
    numbered = pieces.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("region", (F.sum("new").over(along) - 1).cast("int"))
    whole = numbered.groupBy("chrom", "region").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("state").alias("state"))
    return whole.select("chrom", "region", "start", "length", "state")


def mappable_runs(signal: DataFrame, threshold: float = 0.7, min_bins: int = 100) -> DataFrame:
    """Runs of more than ``min_bins`` bins of at least the threshold."""
    return runs(signal.filter(F.col("value") >= threshold), F.lit(1)).filter(F.col("length") > min_bins).select("chrom", "start", "length")
