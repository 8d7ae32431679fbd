"""The driver's tables as signals, peaks and intervals, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigseg.operators.signal import grid, to_grid

#: Hours of the grid at least; later events lengthen it.
HOURS = 720
DAYS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def since(unit: str):
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, bins: the hours up to the latest event of all, for each type of event; an event before the first hour is an error."""
    ends = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("chrom")).agg(F.max("ts").alias("ts"), F.min("ts").alias("first"))
    all_ = Window.partitionBy()  # a row for each type of event
    latest = ends.select("chrom", F.max("ts").over(all_).alias("ts"), F.min("first").over(all_).alias("first"))
    early = F.expr("cast(first as timestamp_ntz) < timestamp_ntz'2024-01-01 00:00:00'")
    bins = F.when(early, F.raise_error(F.lit("an event before 2024-01-01 has no bin")).cast("long")).otherwise(F.greatest(F.lit(HOURS).cast("long"), since("HOUR") + 1))
    return latest.select("chrom", bins.alias("bins"))


def sig_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: chrom, bin, value, n."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), since("HOUR").alias("bin"), "value")
    sums = e.groupBy("chrom", "bin").agg(F.round(F.sum("value"), 6).alias("value"), F.count("*").alias("n"))
    return to_grid(sums, sizes(spark, sf_dir), ("value", "n"))


def mc_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: chrom, bin, track, value for four tracks."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), since("HOUR").alias("bin"), (F.col("user_id") % 4).alias("track"), "value")
    sums = e.groupBy("chrom", "bin", "track").agg(F.round(F.sum("value"), 6).alias("value"))
    full = grid(sizes(spark, sf_dir)).withColumn("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return full.join(sums, ["chrom", "bin", "track"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: id, chrom, start, end, score."""
    e = table(spark, sf_dir, "events").filter("value > 150")
    start = since("SECOND")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), start.alias("start"), (start + 60).alias("end"), F.col("value").alias("score"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, cut at the last hour: id, chrom, start, end, score."""
    start = since("SECOND")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("chrom"), start.alias("start"), (start + 60 * F.ceil("value")).alias("end"), F.col("value").alias("score"))
    ends = e.join(sizes(spark, sf_dir), "chrom").withColumn("end", F.least("end", F.col("bins") * 3600))
    return ends.select("id", "chrom", "start", "end", "score")


#: The same in SQL, for a WITH clause.
SQL = {
    "sizes": "sizes AS (SELECT DISTINCT event_type AS chrom FROM events)",
    "sig": """sizes AS (SELECT DISTINCT event_type AS chrom FROM events), sig AS (
  SELECT g.chrom, g.bin, coalesce(s.value, 0.0)::DOUBLE AS value, coalesce(s.n, 0) AS n
  FROM (SELECT chrom, unnest(generate_series(0, 719)) AS bin FROM sizes) g
  LEFT JOIN (SELECT event_type AS chrom, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS bin, round(sum(value), 6) AS value, count(*) AS n FROM events GROUP BY ALL) s
  ON g.chrom = s.chrom AND g.bin = s.bin)""",
    "mc": """sizes AS (SELECT DISTINCT event_type AS chrom FROM events), mc AS (
  SELECT g.chrom, g.bin, g.track, coalesce(s.value, 0.0)::DOUBLE AS value
  FROM (SELECT chrom, unnest(generate_series(0, 719)) AS bin, track FROM sizes, (SELECT unnest([0, 1, 2, 3]) AS track)) g
  LEFT JOIN (SELECT event_type AS chrom, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS bin, user_id % 4 AS track, round(sum(value), 6) AS value FROM events GROUP BY ALL) s
  ON g.chrom = s.chrom AND g.bin = s.bin AND g.track = s.track)""",
    "peaks": """peaks AS (SELECT event_id AS id, event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS start,
  date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 60 AS "end", value AS score FROM events WHERE value > 150)""",
    "intervals": """iv AS (SELECT event_id AS id, event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS start,
  least(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 60 * ceil(value)::BIGINT, 2592000) AS "end", value AS score FROM events)""",
}
