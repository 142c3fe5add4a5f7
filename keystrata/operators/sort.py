"""Range-partitioned sorts, global ranks and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SortConfig
from .pivots import collect_pivots, partition_of, pivot_indices, select_pivots, tree_of, weighted_pivots
from .sampling import bernoulli_sample, hash_sample, head_sample, sample_size, sampling_ratio

DEFAULT = SortConfig()
STRATEGIES = ("bernoulli", "hash", "head", "exact")
#: Sampled ranges, for each range wanted, among which exact split points are looked for.
FINE = 16


def free(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def choose_pivots(df: DataFrame, key: str, partitions: int, strategy: str = "bernoulli", *, seed: int = 42, source: str | None = None, order: Sequence[str] = (), total: int | None = None, config: SortConfig = DEFAULT) -> list[bytes]:
    """Split points for df's keys. Only keys are read; what reaches the driver is bounded by sample_size, however many rows a key holds.

    bernoulli draws rows; hash draws keys, each with its number of rows, so that any
    layout gives the same split points; head needs `source` and `order`; exact counts
    all keys in Spark and collects the split points only. total: the rows, if known.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if partitions == 1:
        return []
    if strategy == "exact":
        return [bytes(r[key]) for r in exact_pivots(df.select(key), key, partitions, total=total).orderBy("pivot").collect()]
    size = sample_size(partitions, config)
    if strategy == "head":
        if source is None:
            raise ValueError("head sampling needs a source column")
        heads = head_sample(df.select(key, *({source, *order} - {key})), config.head_records, source, order)
        return collect_pivots(bernoulli_sample(heads, sampling_ratio(heads.count(), size), seed), key, partitions)
    ratio = sampling_ratio(df.count() if total is None else total, size)
    if strategy == "hash":
        return weighted_pivots([(bytes(r[0]), r[1]) for r in hash_sample(df.select(key), F.col(key), ratio).groupBy(key).count().collect()], partitions)
    return collect_pivots(bernoulli_sample(df.select(key), ratio, seed), key, partitions)


def exact_pivots(df: DataFrame, key: str, partitions: int, *, total: int | None = None) -> DataFrame:
    """pivot (from 1) and key: df's keys at the equi-depth places; no row if df has fewer rows than partitions.

    Sampled split points cut the keys finely and the ranges are counted; only the
    ranges that hold a wanted place are looked into, a row for each distinct key.
    """
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("binary").alias("k"))
    total = keys.count() if total is None else total
    places = pivot_indices(total, partitions)
    kind = df.schema[key].dataType
    if not places:
        return spark.createDataFrame([], "pivot int, k binary").select("pivot", F.col("k").cast(kind).alias(key))
    ratio = sampling_ratio(total, FINE * 8 * partitions)
    sample = bernoulli_sample(keys, ratio).toArrow().column(0).to_pylist()
    fine = sorted(set(select_pivots(sample, FINE * partitions)))
    ranged = keys.withColumn("r", partition_of(F.col("k"), fine))
    counts = dict(ranged.groupBy("r").count().collect())
    wanted, before = [], 0
    left = list(enumerate(places, 1))
    for r in sorted(counts):
        while left and left[0][1] < before + counts[r]:
            pivot, place = left.pop(0)
            wanted.append((r, pivot, place - before))
        before += counts[r]
    inside = ranged.where(F.col("r").isin([w[0] for w in wanted])).groupBy("r", "k").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("k"))
    found = inside.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(wanted, "r int, pivot int, at long")), "r")
    return found.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("pivot", F.col("k").cast(kind).alias(key))


def range_partition(df: DataFrame, key: str, pivots: Sequence[bytes], pid: str = "pid") -> DataFrame:
    """df with `pid`, the 0-based key range of each row; nothing moves. A column of that name is an error."""
    if pid.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the rows have a column {pid} already")
    return df.withColumn(pid, partition_of(F.col(key), pivots))


def exchange(df: DataFrame, partitions: int, pid: str = "pid") -> DataFrame:
    """Moves each row to the partition of its id: partition i holds range i, as no hash or sampled bound intervenes."""
    return df.repartitionById(partitions, F.col(pid))


def sort_records(df: DataFrame, key: str, partitions: int, *, ties: Sequence[str | Column] = (), pivots: Sequence[bytes] | None = None, strategy: str = "bernoulli", spread: str | None = None, pid: str = "pid", config: SortConfig = DEFAULT, **how) -> DataFrame:
    """df in `partitions` sorted partitions with column `pid`; range i's keys precede range i + 1's.

    One shuffle and one sort. All rows of one key share a partition unless `spread` names a
    column: keys then split on the key followed by that column's digest, which
    keeps the key order and cuts a key that holds many rows.
    """
    if spread is not None:
        name = free(df, "long_key")
        wide = df.withColumn(name, F.concat(F.col(key), F.unhex(F.md5(F.col(spread).cast("string").cast("binary")))))
        points = choose_pivots(wide, name, partitions, strategy, config=config, **how) if pivots is None else pivots
        return exchange(range_partition(wide, name, points, pid), partitions, pid).sortWithinPartitions(pid, name, *ties).drop(name)
    points = choose_pivots(df, key, partitions, strategy, config=config, **how) if pivots is None else pivots
    return exchange(range_partition(df, key, points, pid), partitions, pid).sortWithinPartitions(pid, key, *ties)


def global_rank(df: DataFrame, order: Sequence[str], partitions: int, *, rank: str = "rank") -> DataFrame:
    """df with `rank` (from 1) in the order of the named columns.

    Ranges of the whole order, so that rows of one hot key spread over several, come
    from sampled rows; each is a partition, in which rows are numbered, and the
    ranges' counts give where each begins: no task numbers all rows. The rank of
    rows that are equal in `order` is any of theirs.
    """
    order = list(order)
    keys = df.select(*order)
    ratio = sampling_ratio(keys.count(), sample_size(partitions))
    sample = bernoulli_sample(keys, ratio).orderBy(*order).collect()
    points = [sample[i] for i in pivot_indices(len(sample), partitions)]
    bounds = [F.struct(*[F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(order, p, strict=True)]) for p in points]
    value = F.struct(*order)
    pid, row, start = free(df, "pid"), free(df, "row"), free(df, "start")
    placed = df.withColumn(pid, tree_of(lambda i: value < bounds[i], len(bounds)))
    counts = placed.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    starts, upto = [], 0
    for p, n in sorted(map(tuple, counts)):
        starts.append((p, upto))
        upto += n
    begin = df.sparkSession.createDataFrame(starts, f"{pid} int, {start} long")
    moved = exchange(placed, max(1, len(points) + 1), pid)
    numbered = moved.withColumn(row, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
    return numbered.join(F.broadcast(begin), pid).withColumn(rank, (F.col(start) + F.col(row)).cast("long")).drop(pid, row, start)


def sorted_runs(df: DataFrame, source: str, key: str, pivots: Sequence[bytes], ties: Sequence[str] = ()) -> DataFrame:
    """Each source's rows, cut by range and sorted: pid and pos (from 1) in the run (source, range)."""
    run = Window.partitionBy(source, "pid").orderBy(key, *ties)
    return range_partition(df, key, pivots).withColumn("pos", F.row_number().over(run))


def merge_runs(runs: DataFrame, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """The runs of each range as one sorted sequence: merged_pos (from 1) inside the range."""
    return runs.withColumn("merged_pos", F.row_number().over(Window.partitionBy("pid").orderBy(key, *ties)))


def merge_passes(runs: DataFrame, key: str, fan_in: int, most: int, *, by: str, run: str, ties: Sequence[str] = ()) -> DataFrame:
    """The sorted runs `run` (0 to most - 1) of each `by`, merged in groups of fan_in until one is left: merged_pos (from 1) and n_passes.

    Passes only bound how many files are open at once, which Spark's sorter sees to itself:
    the groups of all passes are worked out for each run's number, and the records are
    merged once, by the group that the last pass leaves.
    """
    plan = merge_plan(most, fan_in)
    group = F.col(run)
    for _ in plan:
        group = F.floor(group / fan_in)
    order = Window.partitionBy(by, group).orderBy(key, *ties)
    return runs.withColumns({"merged_pos": F.row_number().over(order), "n_passes": F.lit(len(plan))})


def merge_fan_in(heap_bytes: int, open_files: int, *, memory_ratio: float = 0.5, buffer_bytes: int = 128 << 10, files_ratio: float = 0.8, files_limit: int = 1024) -> int:
    """Files that one merge pass reads at once: what buffers and file handles allow, less one for the output."""
    return max(1, min(int(heap_bytes * memory_ratio / buffer_bytes), int(min(open_files, files_limit) * files_ratio)) - 1)


def merge_plan(files: int, fan_in: int) -> list[list[int]]:
    """Sizes of the groups of each merge pass until one file is left; no pass for one file or none."""
    if fan_in < 2 and files > 1:
        raise ValueError("a merge pass must take two files at least")
    passes = []
    while files > 1:
        groups = [min(fan_in, files - k) for k in range(0, files, fan_in)]
        passes.append(groups)
        files = len(groups)
    return passes


def merge_groups(files: DataFrame, fan_in: int, order: Sequence[str], by: str) -> DataFrame:
    """files with grp (from 0): which merge of the first pass takes each file, for every value of `by`."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return files.withColumn("grp", F.floor(number / fan_in).cast("int"))


def split_chunks(df: DataFrame, per_chunk: int, by: str, order: Sequence[str], start: int = 1) -> DataFrame:
    """df with chunk: the number of the bounded output file that each row of a range falls in."""
    if per_chunk < 1:
        raise ValueError("a chunk must hold a record at least")
    number = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumn("chunk", (F.floor(number / per_chunk) + start).cast("int"))


def top_records(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in order; each task keeps n, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)
