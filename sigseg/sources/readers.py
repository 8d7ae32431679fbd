"""Text formats of genomic signals as DataFrames, and a Parquet store of signals."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigseg.operators.signal import rasterize


#: Lines of a wig file in which a header is carried on within one group.
WIG_BLOCK = 1 << 16


def _tsv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, comment="#", mode="PERMISSIVE")


def read_bedgraph(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end, score; track lines are skipped. Plain files split, gz files are one task each."""
    rows = _tsv(spark, path, "chrom string, start long, end long, score double")
    return rows.filter(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_wig_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, chrom, start, end, score of variableStep wig files, all in one plan however many files there are.

    A header holds until the next one in its file. Headers are carried within
    blocks of WIG_BLOCK lines, by the reader's own row ids; a block's first
    lines take the last header of the blocks before it, of which there is one
    row for each. Files whose lines lack a header give nothing.
    """
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("t"))
    lines = lines.filter(~F.col("t").startswith("track") & ~F.col("t").startswith("#") & (F.col("t") != ""))
    lines = lines.withColumn("header", F.when(F.col("t").startswith("variableStep"), F.col("t"))).withColumn("block", F.expr(f"line div {WIG_BLOCK}"))
    last = lines.groupBy("file", "block").agg(F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.last("last", True).over(before).alias("carried"))
    order = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("h", F.last("header", True).over(order)).join(carried, ["file", "block"]).withColumn("h", F.coalesce("h", "carried"))
    held = held.filter("header is null and h is not null")
    parts = F.split("t", r"\s+")
    span = F.coalesce(F.nullif(F.regexp_extract("h", r"span=(\d+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))
    start = parts[0].cast("long") - 1
    return held.select("file", F.regexp_extract("h", r"chrom=(\S+)", 1).alias("chrom"), start.alias("start"), (start + span).alias("end"), parts[1].cast("double").alias("score"))


def read_wig(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end, score of ``read_wig_files``."""
    return read_wig_files(spark, path).drop("file")


def _stem(file: str) -> Column:
    """The name of a file up to its first dot."""
    return F.element_at(F.split(F.element_at(F.split(file, "/"), -1), r"\."), 1)


def wig_bins(steps: DataFrame, bin_size: int) -> DataFrame:
    """chrom, bin, value: sums of the scores that begin in each bin, the last partial bin too."""
    return steps.groupBy("chrom", F.expr(f"start div {bin_size}").alias("bin")).agg(F.sum("score").alias("value"))


def read_broad_peaks(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, p_value (-log10) of broadPeak files."""
    rows = _tsv(spark, path, "chrom string, start long, end long, name string, score double, strand string, signal double, p_value double, q_value double")
    return rows.filter("start is not null").select("chrom", "start", "end", "p_value")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """gene, chrom, strand (1 or -1), start, end, cds_start, cds_end, exons of 12-column gene tables."""
    names = "gene string, chrom string, sign string, start long, end long, cds_start long, cds_end long, exons int, exon_starts string, exon_ends string, protein string, align string"
    rows = _tsv(spark, path, names).filter("start is not null")
    return rows.select("gene", "chrom", F.when(F.col("sign") == "+", 1).otherwise(-1).alias("strand"), "start", "end", "cds_start", "cds_end", "exons")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size."""
    return _tsv(spark, path, "chrom string, size long").filter("size is not null")


def parse_metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """file and a map of its ``key=value`` pairs, from lines of ``file<TAB>key=value; key=value``."""
    parts = F.split(F.col(column), "\t", 2)
    pairs = F.regexp_replace(F.regexp_replace(parts[1], r"\s*;\s*", ";"), r";$", "")
    return lines.filter(F.size(parts) == 2).select(parts[0].alias("file"), F.str_to_map(pairs, F.lit(";"), F.lit("=")).alias("meta"))


def wide_metadata(meta: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each key; null where a file lacks it."""
    return meta.select("file", *[F.col("meta")[k].alias(k) for k in keys])


def available_tracks(files: DataFrame, cell: str, experiments: list[str]) -> list[str]:
    """Names ``cell-experiment`` that the catalogue (name) holds; ``fetal_X`` also matches ``X_fetal``."""
    swapped = cell.removeprefix("fetal_") + "_fetal" if cell.startswith("fetal_") else cell
    wanted = [f"{c}-{e}" for e in experiments for c in dict.fromkeys([cell, swapped])]
    return [r["name"] for r in files.filter(F.col("name").isin(wanted)).select("name").distinct().orderBy("name").collect()]


def chrom_names(genome: str) -> list[str]:
    """Chromosomes of a genome. Autosomes of hg19 and mm9."""
    autosomes = {"hg19": 22, "mm9": 19}[genome]
    return [f"chr{i}" for i in range(1, autosomes + 1)] + ["chrX", "chrY"]


def chrom_ids(rows: DataFrame, column: str = "chrom") -> DataFrame:
    """``rows`` with ``chrom_id``: N of chrN, fixed values for Y (24), X (25) and M (26), and from 27 on the other names in their order."""
    named = F.regexp_extract(column, r"^chr(\d+)$", 1)
    fixed = F.when(named != "", named.cast("int")).when(F.col(column) == "chrY", 24).when(F.col(column) == "chrX", 25).when(F.col(column) == "chrM", 26)
    names = rows.select(F.col(column).alias("__name"), fixed.alias("__id")).distinct()
    others = names.filter("__id is null and __name is not null").withColumn("__id", (F.row_number().over(Window.orderBy("__name")) + 26).cast("int"))  # a row for each odd name
    table = names.filter("__id is not null").unionByName(others)
    return rows.join(table.withColumnsRenamed({"__name": column, "__id": "chrom_id"}), column, "left")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, name (below ``path``), size of all files in a folder and the folders below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.col("path").alias("file"), F.regexp_replace(F.substring_index(F.col("path"), root + "/", -1), r"^/+", "").alias("name"), F.col("length").alias("size"))


def transform_pairs(spark: SparkSession, source: str, target: str, pattern: str = "*") -> DataFrame:
    """source, target: each file below a folder and the place of its result in another."""
    return list_files(spark, source, pattern).select(F.col("file").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), F.regexp_replace("name", r"\.[^.]*$", "")).alias("target"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest(spark: SparkSession, source: str, store: str, bin_size: int, kind: str = "bedgraph", skip: str = "filtered-density") -> list[str]:
    """Store every file of a folder as a signal of its own name; those already stored and those named like ``skip`` are left out. Returns the names stored now.

    All files are read in one job and written in one, by name and chromosome.
    """
    pattern = {"bedgraph": r"\.bedGraph(\.gz)?$", "wig": r"\.wig(\.gz)?$"}[kind]
    names = [(r["file"], r["name"].rsplit("/", 1)[-1]) for r in list_files(spark, source).filter(F.col("name").rlike(pattern)).select("file", "name").collect()]  # a row for each file
    new = {file: name.split(".")[0] for file, name in names if skip not in name and not _exists(spark, f"{store.rstrip('/')}/name={name.split('.')[0]}")}
    if not new:
        return []
    if kind == "bedgraph":
        rows = read_bedgraph(spark, list(new)).withColumn("file", F.input_file_name()).withColumn("name", _stem("file"))
        keyed = rows.select(F.concat_ws("\x1f", "name", "chrom").alias("chrom"), "start", "end", "score")
        binned = rasterize(keyed, bin_size)
    else:
        steps = read_wig_files(spark, list(new)).withColumn("chrom", F.concat_ws("\x1f", _stem("file"), "chrom"))
        binned = wig_bins(steps, bin_size)
    split = binned.select(F.split("chrom", "\x1f")[0].alias("name"), F.split("chrom", "\x1f")[1].alias("chrom"), "bin", "value")
    split.write.mode("append").partitionBy("name", "chrom").parquet(store)
    return sorted(new.values())


def merge_steps(steps: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """keys, start, end, score: steps that touch and have one score, merged; nothing else is changed.

    A merged step begins where no step of its score ends, and ends where none
    begins; the k-th begin of a score goes with its k-th end. So only begins and
    ends are ordered, by sequence and score. Equal steps count once; steps of one
    score must not overlap in part.
    """
    each = steps.select(*keys, "start", "end", "score").filter("start < end").distinct()
    place = [*keys, "score", "at"]
    starts, ends = each.select(*keys, "score", F.col("start").alias("at")), each.select(*keys, "score", F.col("end").alias("at"))
    kth = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "score").orderBy("at")))
    opens = kth(starts.join(ends, place, "left_anti")).withColumnRenamed("at", "start")
    closes = kth(ends.join(starts, place, "left_anti")).withColumnRenamed("at", "end")
    return opens.join(closes, [*keys, "score", "k"]).select(*keys, "start", "end", "score")


def wig_to_bedgraph(spark: SparkSession, source: str, target: str, skip: str = "filtered-density") -> list[str]:
    """Convert the wig files of a folder to bedGraph text, below ``target/name=...`` and sorted; names that are already there, or files named like ``skip``, are left out. Returns the names converted now."""
    files = [(r["file"], r["name"].rsplit("/", 1)[-1]) for r in list_files(spark, source).filter(F.col("name").rlike(r"\.wig(\.gz)?$")).select("file", "name").collect()]  # a row for each file
    new = {f: n.split(".")[0] for f, n in files if skip not in n and not _exists(spark, f"{target.rstrip('/')}/name={n.split('.')[0]}")}
    if not new:
        return []
    merged = merge_steps(read_wig_files(spark, list(new)).withColumn("name", _stem("file")), ("name", "chrom"))
    order = ["name", "chrom", "start"]
    merged.repartitionByRange(*order).sortWithinPartitions(*order).select("name", "chrom", "start", "end", "score").write.mode("append").partitionBy("name").csv(target, sep="\t")
    return sorted(new.values())


def load_mappability(spark: SparkSession, source: str, store: str, bin_size: int) -> DataFrame:
    """The share of each bin that is mappable, from a bedGraph file the first time and from the store afterwards."""
    if not _exists(spark, store):
        save_signal(rasterize(read_bedgraph(spark, source), bin_size), store)
    return load_signal(spark, store)


def check_store(signal: DataFrame) -> DataFrame:
    """chrom, bins, rows, duplicates, gaps, nulls, fine: whether each chromosome has every bin from 0 on once and no null."""
    per = signal.groupBy("chrom", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))
    found = per.groupBy("chrom").agg((F.max("bin") + 1).alias("bins"), F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"), F.count("*").alias("there"), F.sum("nulls").alias("nulls"), F.min("bin").alias("low"))
    found = found.withColumn("gaps", F.col("bins") - F.col("there"))
    return found.select("chrom", "bins", "rows", "duplicates", "gaps", "nulls", ((F.col("duplicates") == 0) & (F.col("gaps") == 0) & (F.col("nulls") == 0) & (F.col("low") == 0)).alias("fine"))


def save_signal(signal: DataFrame, path: str, mode: str = "error") -> None:
    """Write chrom, bin, value by chromosome."""
    signal.write.mode(mode).partitionBy("chrom").parquet(path)


def load_signal(spark: SparkSession, path: str, chroms: list[str] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Read a stored signal; only the folders of the asked chromosomes are read."""
    rows = spark.read.parquet(path).withColumn("chrom", F.col("chrom").cast("string"))
    rows = rows.filter(F.col("chrom").isin(chroms)) if chroms is not None else rows
    return rows.transform(transform) if transform else rows


def import_npz(spark: SparkSession, path: str) -> DataFrame:
    """chrom, bin, value of .npz files with one array for each chromosome; pickled content is refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for chrom in arrays.files:
                        for at in range(0, len(arrays[chrom]), 1 << 20):
                            part = arrays[chrom][at : at + (1 << 20)]
                            yield pd.DataFrame({"chrom": chrom, "bin": np.arange(at, at + len(part)), "value": part.astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chrom string, bin long, value double")
