"""Command line: sort, view, validate and generate record files.

    python -m keystrata.cli sort -I in1 in2 -O out -n 8
    python -m keystrata.cli view FILE [MAX] [--detailed]
    python -m keystrata.cli validate OUT
    python -m keystrata.cli generate DIR -n 1000 -s 0 -c 4 [-r]
"""

from __future__ import annotations

import argparse
import logging
import os
import shutil
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import SortConfig
from .functions import records as R
from .operators import validate as V
from .sources import fixedrec as X


def session(level: str = "WARN", log_file: str | None = None) -> SparkSession:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if log_file:
        os.makedirs(os.path.dirname(os.path.abspath(log_file)), exist_ok=True)
        handlers.append(logging.FileHandler(log_file))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=handlers, force=bool(log_file))
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("keystrata").getOrCreate()
    spark.sparkContext.setLogLevel(level)
    return spark


def view(spark: SparkSession, path: str, most: int | None, detailed: bool) -> tuple[list[str], int]:
    """The first records of a file as lines, and how many records it has."""
    rows = X.read_records(spark, [path], columns="record,pos", max_records=most)
    if detailed:
        shown = R.detailed_view(rows).orderBy("pos").collect()
        lines = [f"{r.pos}: key {r.key_hex} |{r.key_ascii}| value {r.value_hex} |{r.value_ascii}|" for r in shown]
    else:
        lines = [r[0] for r in rows.select(R.line_view(F.col("pos"), F.col("record")).alias("line"), "pos").orderBy("pos").collect()]
    return lines, X.whole_record_count([path])


def validate(spark: SparkSession, out: str) -> dict:
    """Violations inside and between the files of an output, records, least and greatest key, checksum."""
    df = X.read_sorted(spark, out).withColumn("key", R.key_of(F.col("record")))
    inside = V.order_violations(df, ["worker", "file"], "pos", "key").agg(F.sum("n_bad")).first()[0] or 0
    files = V.summary_order(V.file_summaries(df, ["worker", "file"], "key", V.record_checksum(F.col("record"))), ["worker", "file"])
    total = files.agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("in_order"), 1).otherwise(0)).alias("bad"), F.sum("checksum").alias("checksum"), F.hex(F.min("first_key")).alias("lo"), F.hex(F.max("last_key")).alias("hi")).first()
    return {"records": total["n"] or 0, "violations": int(inside + (total["bad"] or 0)), "checksum": total["checksum"] or 0, "min_key": total["lo"], "max_key": total["hi"]}


def generate(spark: SparkSession, where: str, per_file: int, offset: int, files: int, reset: bool) -> None:
    """Files of consecutive generated records; numbers go on from file to file."""
    if reset and os.path.isdir(where):
        shutil.rmtree(where)
    rows = R.generated(spark, per_file * files, offset).withColumn("pid", F.floor((F.col("id") - offset) / per_file).cast("int"))
    ordered = rows.repartitionById(files, F.col("pid")).sortWithinPartitions("id")
    X.write_records(ordered.select("record"), where, SortConfig(chunk_bytes=per_file * 100), overwrite=reset)


def main(args: Sequence[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="keystrata")
    top.add_argument("--log-level", default=os.environ.get("LOG_LEVEL", "WARN"))
    top.add_argument("--log-file", help="also log to this file")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("sort")
    p.add_argument("-I", "--inputs", nargs="+", required=True)
    p.add_argument("-O", "--output", required=True)
    p.add_argument("-n", "--partitions", type=int, default=8)
    p.add_argument("--strategy", choices=["bernoulli", "hash", "head", "exact"], help="default: head")
    p = sub.add_parser("view")
    p.add_argument("file")
    p.add_argument("most", nargs="?", type=int)
    p.add_argument("--detailed", action="store_true")
    p = sub.add_parser("validate")
    p.add_argument("output")
    p = sub.add_parser("generate")
    p.add_argument("directory")
    p.add_argument("-n", "--records", type=int, default=1000)
    p.add_argument("-s", "--start", type=int, default=0)
    p.add_argument("-c", "--files", type=int, default=1)
    p.add_argument("-r", "--reset", action="store_true")
    a = top.parse_args(args)
    spark = session(a.log_level, a.log_file) if a.log_file else session(a.log_level)
    if a.command == "sort":
        print(X.sort_files(spark, [d for x in a.inputs for d in x.split(",") if d], a.output, a.partitions, strategy=a.strategy), "records")
    elif a.command == "view":
        lines, n = view(spark, a.file, a.most, a.detailed)
        print(*lines, f"{n} records", sep="\n")
    elif a.command == "validate":
        found = validate(spark, a.output)
        print(*(f"{k}: {v}" for k, v in found.items()), sep="\n")
        return int(found["violations"] > 0)
    else:
        generate(spark, a.directory, a.records, a.start, a.files, a.reset)
    return 0


if __name__ == "__main__":
    sys.exit(main())
