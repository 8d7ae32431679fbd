"""A store of segmentations by cell type, model and chromosome.

Regions are Parquet files in folders of their cell type, model and chromosome,
so a reader lists and reads only the folders that it asks for. A manifest beside
them has one row for each chromosome of a segmentation: its bin size, regions
and bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["cell", "model", "chrom"]
_REGIONS = "region long, start long, length long, state int"
_MANIFEST = "cell string, model string, chrom string, bin_size long, regions long, bins long"


def save_segmentation(regions: DataFrame, path: str, cell: str, model: str, bin_size: int) -> None:
    """Add the regions (chrom, region, start, length, state in bins) of a cell type under a model. Chromosomes that are stored already are replaced, others stay."""
    spark, root = regions.sparkSession, path.rstrip("/")
    rows = regions.select(F.lit(cell).alias("cell"), F.lit(model).alias("model"), "chrom", *[F.col(n).cast(t).alias(n) for n, t in (f.split() for f in _REGIONS.split(", "))])
    keep = {"partitionOverwriteMode": "dynamic"}
    rows.write.mode("overwrite").options(**keep).partitionBy(*KEYS).parquet(f"{root}/regions")
    stored = load_regions(spark, path, cell, model)
    per = stored.groupBy(*KEYS).agg(F.lit(bin_size).cast("long").alias("bin_size"), F.count("*").alias("regions"), (F.max(F.col("start") + F.col("length"))).alias("bins"))
    touched = rows.select("chrom").distinct()
    per.join(F.broadcast(touched), "chrom", "left_semi").write.mode("overwrite").options(**keep).partitionBy(*KEYS).parquet(f"{root}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """cell, model, chrom, bin_size, regions, bins of all that is stored."""
    return spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest").select(*[f.split()[0] for f in _MANIFEST.split(", ")])


def load_regions(spark: SparkSession, path: str, cell: str, model: str, chroms: list[str] | None = None) -> DataFrame:
    """cell, model, chrom, region, start, length, state of one segmentation; only the folders of the asked chromosomes are read."""
    rows = spark.read.schema(f"{_REGIONS}, cell string, model string, chrom string").parquet(f"{path.rstrip('/')}/regions")
    rows = rows.filter((F.col("cell") == cell) & (F.col("model") == model))
    rows = rows.filter(F.col("chrom").isin(chroms)) if chroms is not None else rows
    return rows.select(*KEYS, *[f.split()[0] for f in _REGIONS.split(", ")])


def load_segmentation(spark: SparkSession, path: str, cell: str, model: str, chroms: list[str] | None = None) -> DataFrame:
    """chrom, region, start, length, state with starts and lengths in positions. A segmentation, or a chromosome asked for, that is not stored is an error."""
    have = {r["chrom"]: r["bin_size"] for r in manifest(spark, path).filter((F.col("cell") == cell) & (F.col("model") == model)).collect()}  # a row for each chromosome
    missing = sorted(set(chroms or []) - set(have))
    if not have or missing:
        raise ValueError(f"not stored for {cell} under {model}: {', '.join(missing) or 'anything'}")
    sizes = F.create_map(*[F.lit(x) for c, b in have.items() for x in (c, b)])
    rows, scale = load_regions(spark, path, cell, model, chroms), F.element_at(sizes, F.col("chrom"))
    return rows.select("chrom", "region", (F.col("start") * scale).alias("start"), (F.col("length") * scale).alias("length"), "state")
