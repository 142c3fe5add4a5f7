"""Order, range, conservation and checksum checks of sorted records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pivots import partition_of


def order_violations(df: DataFrame, file: Sequence[str], pos: str, key: str) -> DataFrame:
    """For each file: records, and how many have a smaller key than the one before."""
    before = F.lag(key).over(Window.partitionBy(*file).orderBy(pos))
    marked = df.select(*file, (F.col(key) < before).alias("__bad"))
    return marked.groupBy(*file).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("__bad"), 1).otherwise(0)).alias("n_bad"))


def record_checksum(record: Column) -> Column:
    """A record's share of the order-free checksum: CRC-32 of its bytes."""
    return F.crc32(record)


def file_summaries(df: DataFrame, file: Sequence[str], key: str, checksum: Column) -> DataFrame:
    """For each file: records, least and greatest key, and the sum of checksums."""
    return df.groupBy(*file).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum(checksum).alias("checksum"))


def summary_order(summaries: DataFrame, order: Sequence[str]) -> DataFrame:
    """Summaries in file order with `in_order`: no key of a file precedes the file before. A row for each file."""
    before = F.max("last_key").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return summaries.withColumn("in_order", F.coalesce(F.col("first_key") >= before, F.lit(True)))


def out_of_range(df: DataFrame, key: str, pid: str, pivots: Sequence[bytes]) -> DataFrame:
    """Rows that stand in another range than their key's."""
    return df.where(F.col(pid) != partition_of(F.col(key), pivots))


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: records before and after, and whether they are as many."""
    a, b = before.agg(F.count(F.lit(1)).alias("input_records")), after.agg(F.count(F.lit(1)).alias("output_records"))
    return a.join(F.broadcast(b)).withColumn("conserved", F.col("input_records") == F.col("output_records"))


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Total, least and greatest key."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.hex(F.min(key)).alias("min_key"), F.hex(F.max(key)).alias("max_key"))
