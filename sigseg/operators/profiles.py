"""Mean signal along regions and around their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigseg.operators.regions import with_region


def interpolated(regions: DataFrame, signal: DataFrame, points: int = 100) -> DataFrame:
    """chrom, region, k, value: each region stretched to the same number of points, linearly between bins.

    Each point joins the two bins it lies between; no region is gathered.
    """
    k = regions.select("chrom", "region", "start", "length", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = F.col("k") * F.col("length") / points
    low = F.floor(at)
    placed = k.select("chrom", "region", "k", (F.col("start") + low).alias("b0"), (F.col("start") + F.least(low + 1, F.col("length") - 1)).alias("b1"), (at - low).alias("d"))
    left = signal.select(F.col("chrom").alias("chrom"), F.col("bin").alias("b0"), F.col("value").alias("v0"))
    right = signal.select(F.col("chrom").alias("chrom"), F.col("bin").alias("b1"), F.col("value").alias("v1"))
    both = placed.join(left, ["chrom", "b0"]).join(right, ["chrom", "b1"])
    return both.select("chrom", "region", "k", (F.col("v0") + F.col("d") * (F.col("v1") - F.col("v0"))).alias("value"))


def flanks(regions: DataFrame, signal: DataFrame, width: int) -> DataFrame:
    """chrom, region, offset, value for offsets -width to width - 1 around the start of each region that has room for them."""
    ends = signal.groupBy("chrom").agg(F.max("bin").alias("top"))
    room = regions.join(ends, "chrom").filter((F.col("start") >= width) & (F.col("start") + width - 1 <= F.col("top")))
    cut = room.select("chrom", "region", "start", F.explode(F.sequence(F.lit(-width), F.lit(width - 1))).alias("offset"))
    return cut.withColumn("bin", F.col("start") + F.col("offset")).join(signal.select("chrom", "bin", "value"), ["chrom", "bin"]).select("chrom", "region", "offset", "value")


def weighted_mean(profiles: DataFrame, position: str) -> DataFrame:
    """Mean over chromosomes of each chromosome's mean profile, weighted by its regions."""
    per = profiles.groupBy("chrom", position).agg(F.avg("value").alias("m"), F.count("*").alias("w"))
    return per.groupBy(position).agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("value"))


def marker_profile(regions: DataFrame, tracks: DataFrame) -> DataFrame:
    """region, track, value: mean of each track over each region."""
    total = with_region(tracks, regions).groupBy("chrom", "region", "track").agg(F.sum("value").alias("t"))
    return total.join(regions.select("chrom", "region", "length"), ["chrom", "region"]).select("chrom", "region", "track", (F.col("t") / F.col("length")).alias("value"))


def track_arrays(tracks: DataFrame, names: list) -> DataFrame:
    """chrom, bin, x: the values of all tracks at a bin in the order of ``names``, 0 where a track is absent."""
    wide = tracks.groupBy("chrom", "bin").pivot("track", names).agg(F.sum("value"))
    return wide.select("chrom", "bin", F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names]).alias("x"))


def boundary_profiles(regions: DataFrame, tracks: DataFrame, names: list, width: int = 500, points: int = 100) -> DataFrame:
    """track, part, position, value, regions: mean profiles of all tracks around and inside regions (chrom, region, start, length), in one pass.

    ``left`` are the ``width`` bins before the start, ``right`` those from the end on,
    of the regions that have room for them; ``inside`` is stretched to ``points``,
    linearly between bins. A profile is the mean over chromosomes of each one's
    mean, weighted by its regions. A bin carries all its tracks as one array, so
    regions are joined once however many tracks there are, and what is shuffled
    then is one sum for each track, part, position and task.
    """
    values = track_arrays(tracks, names)
    ends = tracks.groupBy("chrom").agg(F.max("bin").alias("top"))
    placed = regions.select("chrom", "start", (F.col("start") + F.col("length")).alias("end"), "length").join(ends, "chrom")

    def side(part: str, first, room) -> DataFrame:
        at = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("position")
        cut = placed.filter(room).select("chrom", F.lit(part).alias("part"), first.alias("first"), at)
        bin_ = F.col("first") + F.col("position")
        return cut.select("chrom", "part", "position", F.array(F.struct(bin_.alias("bin"), F.lit(1.0).alias("share"))).alias("bins"))

    left = side("left", F.col("start") - width, F.col("start") >= width)
    right = side("right", F.col("end"), F.col("end") + width - 1 <= F.col("top"))
    k = placed.select("chrom", "start", "length", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("position"))
    at = F.col("position") * F.col("length") / points
    low, d = F.floor(at), at - F.floor(at)
    near = F.struct((F.col("start") + low).alias("bin"), (1 - d).alias("share"))
    far = F.struct((F.col("start") + F.least(low + 1, F.col("length") - 1)).alias("bin"), d.alias("share"))
    inside = k.select("chrom", F.lit("inside").alias("part"), "position", F.array(near, far).alias("bins"))
    wanted = left.unionByName(inside).unionByName(right)
    # positions that read the same bin are one row with the sum of their shares before they meet the signal
    weight = wanted.select("chrom", "part", "position", F.explode("bins").alias("b")).groupBy("chrom", "part", "position", F.col("b.bin").alias("bin")).agg(F.sum("b.share").alias("share"))
    met = weight.filter("share > 0").join(values, ["chrom", "bin"]).select("chrom", "part", "position", "share", F.posexplode("x").alias("t", "v"))
    per = met.groupBy("chrom", "part", "position", "t").agg(F.sum(F.col("share") * F.col("v")).alias("total"), F.sum("share").alias("n"))
    track = F.element_at(F.lit(names), F.col("t") + 1)
    return per.groupBy(track.alias("track"), "part", "position").agg((F.sum("total") / F.sum("n")).alias("value"), F.round(F.sum("n")).cast("long").alias("regions"))
