"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a uniform draw from a hash; the record goes to the
shard with the least exponential arrival time -ln(u)/weight. A record's shard
depends on its key, the shard and the weights only, so one more shard takes
records into itself and moves none between the others.

Slots number the records of a shard from 0 without gaps. They come from counts
per (shard, bucket), whose running sums are at most shards * SLOT_BUCKETS rows,
and a row number inside a bucket: no task sorts a whole shard.

Edge cases: a null key is hashed as the empty text; null text has size 1 and
CRC 0; equal rows get neighbouring slots; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Buckets that a shard's slots are numbered by.
SLOT_BUCKETS = 4096
SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that wins the key. Weights are positive and finite."""
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("weights must be positive and finite, one for each shard")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def arrival(j: int, w: float) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(text, F.lit(j)), 11).cast("double")
        return F.struct((-F.log((draw + 0.5) / float(1 << 53)) / w).alias("t"), F.lit(j).alias("shard"))

    return F.array_min(F.array(*[arrival(j, w) for j, w in enumerate(weights)]))["shard"]


def shard_records(df: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = ()) -> DataFrame:
    """df's rows with shard int and slot long; `order` breaks ties between equal keys."""
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    placed = df.withColumns({"shard": rendezvous(F.col(key), weights), "__bucket": bucket})
    counts = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy(key, *order)
    numbered = placed.withColumn("__row", F.row_number().over(inside) - 1)
    # starts has at most len(weights) * SLOT_BUCKETS rows: a proven bound for the broadcast.
    return (
        numbered.join(F.broadcast(starts), ["shard", "__bucket"])
        .withColumn("slot", F.col("__start") + F.col("__row"))
        .drop("__bucket", "__start", "__row")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    sharded = shard_records(docs, "doc_id", [1.0] * SHARDS, ("size", "text_crc32"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
