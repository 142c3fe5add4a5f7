"""How an exchange moves its blocks, and the tally of what arrived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("sequential", "limited", "per_source", "independent")


def exchange_settings(strategy: str = "independent", limit: int | None = None, timeout_seconds: int = 120) -> dict[str, str]:
    """Session settings, to be set when it is built, that make Spark's shuffle fetch in this manner.

    sequential: one request at a time. limited: at most `limit` (10) requests. per_source:
    at most `limit` (1) blocks of one source at a time. independent: Spark's own
    pipelines, the default. A fetch that times out is retried by Spark.
    """
    common = {"spark.network.timeout": f"{timeout_seconds}s"}
    if strategy == "sequential":
        return common | {"spark.reducer.maxReqsInFlight": "1"}
    if strategy == "limited":
        return common | {"spark.reducer.maxReqsInFlight": str(limit or 10)}
    if strategy == "per_source":
        return common | {"spark.reducer.maxBlocksInFlightPerAddress": str(limit or 1)}
    if strategy == "independent":
        return common
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def rounds(runs: DataFrame, strategy: str = "independent", limit: int | None = None, source: str = "i", order: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """runs with round (from 0): which wave of the exchange fetches each. Runs of one round are fetched together.

    sequential: one run a round. limited: `limit` (10) runs a round. per_source: `limit` (1) runs
    of every source a round. independent: all in one round.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "independent":
        return runs.withColumn("round", F.lit(0))
    # The catalog has a row for each run, not for each record: sources x ranges x files.
    by = Window.partitionBy(source) if strategy == "per_source" else Window.partitionBy(F.lit(0))
    at_once = {"sequential": 1, "limited": limit or 10, "per_source": limit or 1}[strategy]
    return runs.withColumn("round", F.floor((F.row_number().over(by.orderBy(*order)) - 1) / at_once).cast("int"))


def outcomes(sent: DataFrame, received: DataFrame, source: str = "src", pid: str = "pid") -> DataFrame:
    """Every (source, range) that was sent, and ok: whether as many rows have arrived."""
    a = sent.groupBy(source, pid).agg(F.count(F.lit(1)).alias("sent"))
    b = received.groupBy(source, pid).agg(F.count(F.lit(1)).alias("received"))
    return a.join(b, [source, pid], "left").fillna(0, ["received"]).withColumn("ok", F.col("sent") == F.col("received"))


def tally(transfers: DataFrame, ok: Column) -> DataFrame:
    """One row: transfers that succeeded and that failed."""
    return transfers.agg(F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0)).alias("n_success"), F.coalesce(F.sum(F.when(ok, 0).otherwise(1)), F.lit(0)).alias("n_failure"))


def failures_by_source(transfers: DataFrame, ok: Column, source: str = "i") -> DataFrame:
    return transfers.where(~ok).groupBy(source).agg(F.count(F.lit(1)).alias("n_failure"))
