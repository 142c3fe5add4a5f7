"""Run files: their names, and which runs each range needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the form of a run file's name; source, range, file of the source.
NAME = r"^file_(\d+)_(\d+)_(\d+)\.dat$"
FORMAT = "file_%d_%d_%d.dat"


def run_name(i: Column, j: Column, k: Column) -> Column:
    return F.format_string(FORMAT, i, j, k)


def parse_names(df: DataFrame, name: str = "name") -> DataFrame:
    """i, j, k of the names that are run files; other names are dropped, repeated ones count once."""
    part = lambda n: F.regexp_extract(F.col(name), NAME, n).cast("int")
    return df.where(F.col(name).rlike(NAME)).select(part(1).alias("i"), part(2).alias("j"), part(3).alias("k")).distinct()


def expected_runs(files: DataFrame, partitions: int) -> DataFrame:
    """A run for each (source i, file k) and range 1 to partitions."""
    return files.select("i", F.explode(F.sequence(F.lit(1), F.lit(partitions))).alias("j"), "k")


def full_catalog(spark: SparkSession, workers: int) -> DataFrame:
    """One run of every source for every range."""
    ids = spark.range(1, workers + 1)
    return expected_runs(ids.select(F.col("id").cast("int").alias("i"), F.lit(0).alias("k")), workers)


def group_runs(runs: DataFrame) -> DataFrame:
    """j, files: the runs of each range in order. Runs number sources x files, not records."""
    return runs.groupBy("j").agg(F.sort_array(F.collect_set(F.struct("i", "j", "k"))).alias("files"))


def needed_runs(runs: DataFrame, j: int) -> DataFrame:
    return runs.where(F.col("j") == j).distinct()


def transfer_counts(sent: DataFrame, received: DataFrame, source: str = "src") -> DataFrame:
    """Rows sent and received of each (source, range), and whether all arrived."""
    a = sent.groupBy(source, "pid").agg(F.count(F.lit(1)).alias("sent"))
    b = received.groupBy(source, "pid").agg(F.count(F.lit(1)).alias("received"))
    joined = a.join(b, [source, "pid"], "full").fillna(0, ["sent", "received"])
    return joined.withColumn("complete", F.col("sent") == F.col("received"))
