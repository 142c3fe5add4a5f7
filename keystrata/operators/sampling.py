"""Samples of keys from which split points are chosen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SortConfig

DEFAULT = SortConfig()
#: Sampled keys for each partition.
SAMPLES = 100


def sample_budget(partitions: int, config: SortConfig = DEFAULT) -> int:
    """Keys to sample in total: what the driver's share of memory holds, and no more than each partition's allowance."""
    by_memory = config.memory_bytes * config.memory_ratio / config.key_length
    by_partition = partitions * config.bytes_per_worker / config.key_length
    return int(min(by_memory, by_partition))


def sample_size(partitions: int, config: SortConfig = DEFAULT) -> int:
    """Keys that come to the driver: SAMPLES for each partition balance the ranges; the budget is an upper bound."""
    return min(sample_budget(partitions, config), SAMPLES * partitions)


def sampling_ratio(total: int, budget: int) -> float:
    """Share of all records that gives the budget: 0 for no records, at most 1."""
    return 0.0 if total <= 0 else min(budget / total, 1.0)


def head_sample(df: DataFrame, n: int, source: Sequence[str] | str, order: Sequence[str]) -> DataFrame:
    """The first n rows of each source in the given order (file, position).

    Spark limits each task's rows of a source to n before it shuffles them.
    """
    by = [source] if isinstance(source, str) else list(source)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def bernoulli_sample(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Each row with this probability; the rows chosen depend on how df is partitioned."""
    return df.sample(withReplacement=False, fraction=min(max(ratio, 0.0), 1.0), seed=seed)


def hash_position(key: Column) -> Column:
    """A uniform number in [0, 2^32) that the key alone decides."""
    return F.conv(F.substring(F.md5(F.hex(key).cast("binary")), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: Column, ratio: float) -> DataFrame:
    """The rows whose key's digest falls below the ratio: the same rows on any layout, all or none of equal keys.

    A key may hold any share of the rows: group by it before anything is collected.
    """
    return df.where(hash_position(key) < F.lit(int(ratio * (1 << 32))))
