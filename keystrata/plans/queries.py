"""Every operator of the sort engine as a query over the tables, with the equivalent SQL where there is any."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SortConfig
from ..functions import records as R
from ..operators import catalog as C
from ..operators import pivots as P
from ..operators import sampling as S
from ..operators import sort as O
from ..operators import transfer as T
from ..operators import validate as V
from ..sources import fixedrec as X

CONFIG = SortConfig()
#: Ranges of the queries, runs of a merge pass, and records of an output file.
W, FAN_IN, PER_CHUNK, HEAD, ODD = 7, 3, 500, 100, 64
TIES = ["l_partkey", "l_suppkey", "l_extendedprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as records: a 10-byte key with many repeats, a text value, and a simulated source."""
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *TIES)
    key = R.numeric_key((F.col("l_orderkey"), 8), (F.col("l_linenumber"), 2))
    value = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return t.select("l_linenumber", *TIES, key.alias("key"), R.record_from(key, value, CONFIG).alias("record"), (F.col("l_suppkey") % 4).alias("src"))


def _hexed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.hex("key").alias("key_hex"), *more)


def _pivots(lines: DataFrame) -> list[bytes]:
    return O.choose_pivots(lines, "key", W, "exact")


def _ranged(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    points = _pivots(lines)
    return O.range_partition(lines, "key", points), points


def _runs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return O.sorted_runs(lines, "src", "key", _pivots(lines), TIES)


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: below the session's checkpoint folder, or else the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(top.removeprefix("file://").removeprefix("file:"), f"keystrata-records-{uuid.uuid4().hex}")


def global_sort(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return O.global_rank(lines, ["key", *TIES], W).select("rank", F.hex("key").alias("key_hex"), "l_partkey", "l_suppkey")


def sort_text_key(spark, sf_dir):
    names = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("key"))
    return O.global_rank(names, ["key", "c_custkey"], W).select("rank", F.hex("key").alias("name_hex"), "c_custkey")


def sort_event_key(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", R.numeric_key((F.col("user_id"), 8)).alias("key"))
    return O.global_rank(events, ["key", "event_id"], W).select("rank", F.hex("key").alias("key_hex"), "event_id")


def range_sort(spark, sf_dir):
    """The sort itself: each row's range and its place in the range's sorted output."""
    lines = _lines(spark, sf_dir)
    done = O.sort_records(lines, "key", W, ties=TIES, strategy="exact")
    return O.merge_runs(done, "key", TIES).select("pid", "merged_pos", F.hex("key").alias("key_hex"))


def spread_sort(spark, sf_dir):
    """Sort whose hot keys may be cut between partitions: rows stay in key order over the partitions."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", R.numeric_key((F.col("o_custkey"), 8)).alias("key"))
    done = O.sort_records(orders, "key", W, spread="o_orderkey", strategy="exact")
    bounds = done.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    before = F.max("hi").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    return bounds.withColumn("ok", F.coalesce(F.col("lo") >= before, F.lit(True))).select("pid", "n", "ok")


def key_value_projection(spark, sf_dir):
    rec = F.col("record")
    return _lines(spark, sf_dir).select(F.hex(R.key_of(rec, checked=True)).alias("key_hex"), F.hex(R.value_of(rec)).alias("value_hex"))


def record_count(spark, sf_dir):
    """Sizes of the files of each source, taken as records of ODD bytes, which the files' ends cut: records of all bytes together, and whole records of each file."""
    where = _scratch(spark)
    lines = _lines(spark, sf_dir).select(F.col("src").cast("int").alias("src"), "record")
    X.write_records(O.exchange(lines, 4, "src").select("record"), where, SortConfig(chunk_bytes=PER_CHUNK * 100))
    folders = [(src, [os.path.join(where, f"worker_{src + 1}")]) for src in range(4)]
    rows = [(src, X.record_count(f, ODD), X.whole_record_count(f, ODD)) for src, f in folders]
    return spark.createDataFrame(rows, "src long, record_count_bytes long, record_count long")


def multi_source_union(spark, sf_dir):
    a = _lines(spark, sf_dir).select(F.lit("lineitem").alias("source"), "key")
    b = _table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), R.numeric_key((F.col("o_custkey"), 8)).alias("key"))
    c = _table(spark, sf_dir, "events").select(F.lit("events").alias("source"), R.numeric_key((F.col("user_id"), 8)).alias("key"))
    return a.unionByName(b).unionByName(c).groupBy("source", F.hex("key").alias("key_hex")).agg(F.count(F.lit(1)).alias("n"))


def head_sample(spark, sf_dir):
    placed = _lines(spark, sf_dir)
    return _hexed(S.head_sample(placed, HEAD, "src", ["l_extendedprice", "key", "l_partkey", "l_suppkey"]), "src", "l_partkey", "l_suppkey")


def hash_sample(spark, sf_dir):
    return _hexed(S.hash_sample(_lines(spark, sf_dir), F.col("key"), 0.05), "l_partkey", "l_suppkey")


def bernoulli_sample(spark, sf_dir):
    return _hexed(S.bernoulli_sample(_lines(spark, sf_dir), 0.05))


def sampling_ratio(spark, sf_dir):
    """Budget and ratio for 1 to 20 partitions."""
    small = SortConfig(memory_bytes=200_000, bytes_per_worker=4_000)
    total = _table(spark, sf_dir, "lineitem").count()
    rows = [(w, S.sample_budget(w, small), S.sampling_ratio(total, S.sample_budget(w, small))) for w in range(1, 21)]
    return spark.createDataFrame(rows, "w int, budget long, ratio double")


def sample_sort(spark, sf_dir):
    sample = S.hash_sample(_lines(spark, sf_dir), F.col("key"), 0.05)
    return O.global_rank(sample, ["key", *TIES], W).select("rank", F.hex("key").alias("key_hex"))


def select_pivots(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return O.exact_pivots(lines, "key", W).select("pivot", F.hex("key").alias("key_hex"))


def select_pivots_few(spark, sf_dir):
    """Fewer samples than partitions give no split point."""
    few = _table(spark, sf_dir, "region").select(F.col("r_name").cast("binary").alias("key"))
    return O.exact_pivots(few, "key", W).select("pivot", F.hex("key").alias("key_hex"))


def padded_pivots(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    points = O.exact_pivots(lines, "key", W)
    return points.select("pivot", F.hex(R.padded(F.col("key"))).alias("record_hex"))


def range_partition(spark, sf_dir):
    ranged, _ = _ranged(spark, sf_dir)
    return _hexed(ranged, "pid", "l_partkey", "l_suppkey")


def partition_histogram(spark, sf_dir):
    ranged, _ = _ranged(spark, sf_dir)
    return ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("record")).alias("bytes"), F.hex(F.min("key")).alias("min_key"), F.hex(F.max("key")).alias("max_key"))


def local_sort_runs(spark, sf_dir):
    return _hexed(_runs(spark, sf_dir), "src", "pid", "pos", "l_partkey", "l_suppkey")


def _files(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4 + 1).cast("int").alias("i"), (F.col("l_linenumber") - 1).cast("int").alias("k")).distinct()


def run_names(spark, sf_dir):
    """Names written and parsed back; a name of another form is dropped."""
    runs = C.expected_runs(_files(spark, sf_dir), W)
    names = runs.select(C.run_name(F.col("i"), F.col("j"), F.col("k")).alias("name"))
    return C.parse_names(names.unionByName(names.select(F.concat("name", F.lit(".tmp")).alias("name"))))


def run_catalog(spark, sf_dir):
    grouped = C.group_runs(C.expected_runs(_files(spark, sf_dir), W))
    return grouped.select("j", F.size("files").alias("n_files"), F.array_join(F.transform("files", lambda f: C.run_name(f["i"], f["j"], f["k"])), ",").alias("files"))


def needed_runs(spark, sf_dir):
    return C.needed_runs(C.expected_runs(_files(spark, sf_dir), W), 3)


def full_catalog(spark, sf_dir):
    return C.full_catalog(spark, W)


def exchange(spark, sf_dir):
    """Rows of each (source, range) before and after they move, and whether each is where its range belongs."""
    ranged, _ = _ranged(spark, sf_dir)
    moved = O.exchange(ranged, W)
    wrong = moved.where(F.spark_partition_id() != F.col("pid")).select("src", "pid").groupBy("src", "pid").agg(F.count(F.lit(1)).alias("misplaced"))
    return C.transfer_counts(ranged, moved).join(wrong, ["src", "pid"], "left").fillna(0, ["misplaced"])


def kway_merge(spark, sf_dir):
    return _hexed(O.merge_runs(_runs(spark, sf_dir), "key", TIES), "pid", "merged_pos")


def multi_pass_merge(spark, sf_dir):
    """Each range's runs, one of every source, merged in passes of a small fan-in."""
    merged = O.merge_passes(_runs(spark, sf_dir), "key", FAN_IN, 4, by="pid", run="src", ties=TIES)
    return _hexed(merged, "pid", "merged_pos", "n_passes")


def merge_fan_in(spark, sf_dir):
    """Files that a pass takes at once, by heap, open files and threads that share both."""
    rows = [(heap, files, threads, O.merge_fan_in(heap // threads, files // threads if threads > 1 else files)) for heap in (1 << 24, 1 << 30, 1 << 33) for files in (64, 1024, 4096) for threads in (1, 4)]
    return spark.createDataFrame(rows, "heap_bytes long, open_files int, threads int, fan_in int")


def merge_groups(spark, sf_dir):
    """First-pass groups of each range's runs."""
    return O.merge_groups(C.expected_runs(_files(spark, sf_dir), W), FAN_IN, ["i", "k"], "j")


def merge_plan(spark, sf_dir):
    """Groups of every pass over 1 to 20 files."""
    rows = [(n, p + 1, len(groups)) for n in range(1, 21) for p, groups in enumerate(O.merge_plan(n, FAN_IN))]
    return spark.createDataFrame(rows, "n_files int, pass int, n_groups int")


def chunk_split(spark, sf_dir):
    ranged, _ = _ranged(spark, sf_dir)
    cut = O.split_chunks(ranged, PER_CHUNK, "pid", ["key", *TIES])
    return cut.groupBy("pid", "chunk").agg(F.count(F.lit(1)).alias("n"), F.hex(F.min("key")).alias("first_key"), F.hex(F.max("key")).alias("last_key"))


def validate_order(spark, sf_dir):
    return V.order_violations(_runs(spark, sf_dir), ["src", "pid"], "pos", "key")


def validate_unsorted(spark, sf_dir):
    """The same check finds the violations of unsorted sources."""
    by_price = F.row_number().over(Window.partitionBy("src").orderBy("l_extendedprice", "key", "l_partkey", "l_suppkey"))
    return V.order_violations(_lines(spark, sf_dir).withColumn("pos", by_price), ["src"], "pos", "key")


def _digest(key):
    return F.conv(F.substring(F.md5(F.hex(key).cast("binary")), 1, 8), 16, 10).cast("long")


def validate_summary(spark, sf_dir):
    ranged, _ = _ranged(spark, sf_dir)
    found = V.summary_order(V.file_summaries(ranged, ["pid"], "key", _digest(F.col("key"))), ["pid"])
    return found.select("pid", "n", F.hex("first_key").alias("first_key"), F.hex("last_key").alias("last_key"), "checksum", "in_order")


def validate_range(spark, sf_dir):
    """Written files read back: records that stand in another worker's folder than their key's range says."""
    where, lines = _scratch(spark), _lines(spark, sf_dir)
    points = _pivots(lines)
    X.write_records(O.sort_records(lines, "key", W, pivots=points).select("record"), where, CONFIG)
    back = X.read_sorted(spark, where).select((F.col("worker") - 1).alias("pid"), R.key_of(F.col("record")).alias("key"))
    out = V.out_of_range(back, "key", "pid", points).groupBy("pid").agg(F.count(F.lit(1)).alias("n_out"))
    read = back.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return read.join(F.broadcast(out), "pid", "left").fillna(0, ["n_out"])


def conservation(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return V.conservation(lines, O.sort_records(lines, "key", W, ties=TIES, strategy="exact"))


def checksum(spark, sf_dir):
    return _lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(_digest(F.col("record"))).alias("checksum"))


def crc_checksum(spark, sf_dir):
    """The order-free CRC sum before and after the sort."""
    lines = _lines(spark, sf_dir)
    total = lambda df: df.agg(F.sum(V.record_checksum(F.col("record"))).alias("c"))
    done = O.sort_records(lines, "key", W, ties=TIES, strategy="exact")
    return total(lines).select(F.col("c").alias("before")).join(F.broadcast(total(done).select(F.col("c").alias("after"))))


def min_max_key(spark, sf_dir):
    return V.key_report(_lines(spark, sf_dir), "key")


def phase_counters(spark, sf_dir):
    """Records by bytes after each phase: sort, exchange, merge."""
    runs = _runs(spark, sf_dir)
    count = lambda df, name: df.agg(F.lit(name).alias("phase"), F.floor(F.sum(F.length("record")) / CONFIG.record_length).alias("records"))
    return count(runs, "sort").unionByName(count(O.exchange(runs, W), "exchange")).unionByName(count(O.merge_runs(runs, "key", TIES), "merge"))


def view_hex(spark, sf_dir):
    return _lines(spark, sf_dir).select(R.to_hex(F.col("key")).alias("key_hex"), R.to_hex(R.value_of(F.col("record"))).alias("value_hex"))


def view_ascii(spark, sf_dir):
    """ASCII view of text bytes: everything outside 32 to 126 becomes a dot."""
    return _table(spark, sf_dir, "customer").select("c_custkey", R.to_ascii(F.col("c_name").cast("binary")).alias("ascii"))


def view_detailed(spark, sf_dir):
    shown = R.detailed_view(_lines(spark, sf_dir))
    return shown.select("key_hex", "key_ascii", "value_hex", "value_ascii")


def view_topk(spark, sf_dir):
    first = O.top_records(_lines(spark, sf_dir), 20, ["key", *TIES])
    number = F.row_number().over(Window.orderBy("key", *TIES)) - 1  # 20 rows
    return first.select(R.line_view(number, F.col("record")).alias("line"))


def generate_records(spark, sf_dir):
    return R.generated(spark, 1000, offset=500).select("id", F.hex(R.key_of(F.col("record"))).alias("key_hex"), R.to_ascii(R.value_of(F.col("record"))).alias("value"))


def demo_records(spark, sf_dir):
    return R.demo(spark).select("id", F.hex(R.key_of(F.col("record"))).alias("key_hex"), R.to_ascii(R.value_of(F.col("record"))).alias("value"))


def _outcomes(spark, sf_dir):
    """An exchange that loses some runs on its way: what of each (source, range) arrived, by counting rows."""
    ranged, _ = _ranged(spark, sf_dir)
    arrived = O.exchange(ranged, W).where((F.col("src") * 7 + F.col("pid") * 3) % 5 != 0)
    return T.outcomes(ranged, arrived)


def transfer_tally(spark, sf_dir):
    return T.tally(_outcomes(spark, sf_dir), F.col("ok"))


def failures_by_source(spark, sf_dir):
    return T.failures_by_source(_outcomes(spark, sf_dir), F.col("ok"), "src")


def exchange_rounds(spark, sf_dir):
    """Which runs each strategy fetches together."""
    runs = C.expected_runs(_files(spark, sf_dir), W)
    rounds = [T.rounds(runs, s).select(F.lit(s).alias("strategy"), "i", "j", "k", "round") for s in T.STRATEGIES]
    return rounds[0].unionByName(rounds[1]).unionByName(rounds[2]).unionByName(rounds[3])


def _write_inputs(spark, lines, where):
    """Two folders of unsorted record files."""
    config = SortConfig(chunk_bytes=50_000)
    for n in (0, 1):
        X.write_records(lines.where(F.col("src") % 2 == n).select("record").repartition(3), os.path.join(where, f"in{n}"), config)
    return [os.path.join(where, f"in{n}", d) for n in (0, 1) for d in sorted(os.listdir(os.path.join(where, f"in{n}")))]


def file_roundtrip(spark, sf_dir):
    folders = _write_inputs(spark, _lines(spark, sf_dir), _scratch(spark))
    back = X.read_records(spark, folders)
    return back.select(F.hex(R.key_of(F.col("record"))).alias("key_hex"), F.hex(R.value_of(F.col("record"))).alias("value_hex"))


def sort_files(spark, sf_dir):
    """Files to files: every record's output folder, file number and place."""
    where = _scratch(spark)
    config = SortConfig(chunk_bytes=PER_CHUNK * 100)
    X.sort_files(spark, _write_inputs(spark, _lines(spark, sf_dir), where), os.path.join(where, "out"), W, strategy="exact", config=config)
    done = X.read_sorted(spark, os.path.join(where, "out"), config)
    return done.select("worker", "file", "pos", F.hex(R.key_of(F.col("record"))).alias("key_hex"))


QUERIES = {
    f.__name__: f
    for f in (
        global_sort, sort_text_key, sort_event_key, range_sort, spread_sort, key_value_projection, record_count, multi_source_union, head_sample, hash_sample, bernoulli_sample, sampling_ratio,
        sample_sort, select_pivots, select_pivots_few, padded_pivots, range_partition, partition_histogram, local_sort_runs, run_names, run_catalog, needed_runs, full_catalog, exchange,
        kway_merge, multi_pass_merge, merge_groups, merge_fan_in, merge_plan, chunk_split, validate_order, validate_unsorted, validate_summary, validate_range, conservation, checksum, crc_checksum, min_max_key,
        phase_counters, view_hex, view_ascii, view_detailed, view_topk, generate_records, demo_records, transfer_tally, failures_by_source, exchange_rounds, file_roundtrip, sort_files,
    )
}

_T = "l_partkey, l_suppkey, l_extendedprice"
_L = """l AS (
  SELECT lpad(hex(l_orderkey), 16, '0') || lpad(hex(l_linenumber), 4, '0') AS key_hex, CAST(l_linenumber AS INTEGER) AS l_linenumber,
    l_partkey, l_suppkey, l_extendedprice, l_suppkey % 4 AS src,
    rpad(hex(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), 180, '20') AS value_hex,
    rpad(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR), 90, ' ') AS value
  FROM lineitem
)"""
_PIV = f"""s AS (SELECT key_hex, row_number() OVER (ORDER BY key_hex) - 1 AS rn, count(*) OVER () AS n FROM l),
piv AS (
  SELECT CAST(i AS INTEGER) AS "pivot", s.key_hex FROM s, (SELECT unnest(generate_series(1, {W - 1})) AS i) g
  WHERE s.rn = i * (n // {W}) + least(i, n % {W}) AND n >= {W}
)"""
_R = f"""{_PIV}, r AS (SELECT l.*, CAST((SELECT count(*) FROM piv WHERE piv.key_hex <= l.key_hex) AS INTEGER) AS pid FROM l)"""
_MD5 = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT)"
_FILES = "f AS (SELECT DISTINCT CAST(l_suppkey % 4 + 1 AS INTEGER) AS i, CAST(l_linenumber - 1 AS INTEGER) AS k FROM lineitem)"
_RUNS = f"{_FILES}, c AS (SELECT i, CAST(j AS INTEGER) AS j, k FROM f, (SELECT unnest(generate_series(1, {W})) AS j) g)"

ORACLE_SQL = {
    "global_sort": f"WITH {_L} SELECT row_number() OVER (ORDER BY key_hex, {_T}) AS rank, key_hex, l_partkey, l_suppkey FROM l",
    "sort_text_key": "SELECT row_number() OVER (ORDER BY hex(c_name), c_custkey) AS rank, hex(c_name) AS name_hex, c_custkey FROM customer",
    "sort_event_key": "SELECT row_number() OVER (ORDER BY user_id, event_id) AS rank, lpad(hex(user_id), 16, '0') AS key_hex, event_id FROM events",
    "range_sort": f"WITH {_L}, {_R} SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY key_hex, {_T}) AS INTEGER) AS merged_pos, key_hex FROM r",
    "key_value_projection": f"WITH {_L} SELECT key_hex, value_hex FROM l",
    "record_count": f"SELECT l_suppkey % 4 AS src, CAST(count(*) * 100 // {ODD} AS BIGINT) AS record_count_bytes, "
    f"CAST(count(*) // {PER_CHUNK} * ({PER_CHUNK * 100} // {ODD}) + count(*) % {PER_CHUNK} * 100 // {ODD} AS BIGINT) AS record_count FROM lineitem GROUP BY 1",
    "spread_sort": f"""WITH o AS (SELECT lpad(hex(o_custkey), 16, '0') AS k, lpad(hex(o_custkey), 16, '0') || upper(md5(CAST(o_orderkey AS VARCHAR))) AS key_hex FROM orders),
s AS (SELECT key_hex, row_number() OVER (ORDER BY key_hex) - 1 AS rn, count(*) OVER () AS n FROM o),
piv AS (SELECT s.key_hex FROM s, (SELECT unnest(generate_series(1, {W - 1})) AS i) g WHERE s.rn = i * (n // {W}) + least(i, n % {W}) AND n >= {W}),
p AS (SELECT CAST((SELECT count(*) FROM piv WHERE piv.key_hex <= o.key_hex) AS INTEGER) AS pid FROM o)
SELECT pid, count(*) AS n, TRUE AS ok FROM p GROUP BY pid""",
    "multi_source_union": f"WITH {_L}, u AS (SELECT 'lineitem' AS source, key_hex FROM l UNION ALL SELECT 'orders', lpad(hex(o_custkey), 16, '0') FROM orders "
    "UNION ALL SELECT 'events', lpad(hex(user_id), 16, '0') FROM events) SELECT source, key_hex, count(*) AS n FROM u GROUP BY 1, 2",
    "head_sample": f"WITH {_L}, h AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY l_extendedprice, key_hex, l_partkey, l_suppkey) AS n FROM l) "
    f"SELECT key_hex, src, l_partkey, l_suppkey FROM h WHERE n <= {HEAD}",
    "hash_sample": f"WITH {_L} SELECT key_hex, l_partkey, l_suppkey FROM l WHERE {_MD5.format('key_hex')} < {int(0.05 * (1 << 32))}",
    "sampling_ratio": "WITH g AS (SELECT CAST(unnest(generate_series(1, 20)) AS INTEGER) AS w), b AS (SELECT w, CAST(floor(least(200000 * 0.3 / 10, w * 4000 / 10.0)) AS BIGINT) AS budget FROM g), "
    "n AS (SELECT count(*) AS n FROM lineitem) SELECT w, budget, CASE WHEN n = 0 THEN 0.0 ELSE least(CAST(budget AS DOUBLE) / n, 1.0) END AS ratio FROM b, n",
    "sample_sort": f"WITH {_L} SELECT row_number() OVER (ORDER BY key_hex, {_T}) AS rank, key_hex FROM l WHERE {_MD5.format('key_hex')} < {int(0.05 * (1 << 32))}",
    "select_pivots": f"WITH {_L}, {_PIV} SELECT \"pivot\", key_hex FROM piv",
    "select_pivots_few": "SELECT CAST(1 AS INTEGER) AS pivot, hex(r_name) AS key_hex FROM region WHERE (SELECT count(*) FROM region) >= 7",
    "padded_pivots": f"WITH {_L}, {_PIV} SELECT \"pivot\", rpad(key_hex, 200, '0') AS record_hex FROM piv",
    "range_partition": f"WITH {_L}, {_R} SELECT key_hex, pid, l_partkey, l_suppkey FROM r",
    "partition_histogram": f"WITH {_L}, {_R} SELECT pid, count(*) AS n, count(*) * 100 AS bytes, min(key_hex) AS min_key, max(key_hex) AS max_key FROM r GROUP BY pid",
    "local_sort_runs": f"WITH {_L}, {_R} SELECT key_hex, src, pid, CAST(row_number() OVER (PARTITION BY src, pid ORDER BY key_hex, {_T}) AS INTEGER) AS pos, l_partkey, l_suppkey FROM r",
    "run_names": f"WITH {_RUNS} SELECT i, j, k FROM c",
    "run_catalog": f"WITH {_RUNS} SELECT j, CAST(count(*) AS INTEGER) AS n_files, string_agg('file_' || i || '_' || j || '_' || k || '.dat', ',' ORDER BY i, k) AS files FROM c GROUP BY j",
    "needed_runs": f"WITH {_RUNS} SELECT i, j, k FROM c WHERE j = 3",
    "full_catalog": f"SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, CAST(0 AS INTEGER) AS k FROM (SELECT unnest(generate_series(1, {W})) AS i) a, (SELECT unnest(generate_series(1, {W})) AS j) b",
    "exchange": f"WITH {_L}, {_R} SELECT src, pid, count(*) AS sent, count(*) AS received, TRUE AS complete, CAST(0 AS BIGINT) AS misplaced FROM r GROUP BY src, pid",
    "kway_merge": f"WITH {_L}, {_R} SELECT key_hex, pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY key_hex, {_T}) AS INTEGER) AS merged_pos FROM r",
    "multi_pass_merge": f"WITH {_L}, {_R} SELECT key_hex, pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY key_hex, {_T}) AS INTEGER) AS merged_pos, CAST(2 AS INTEGER) AS n_passes FROM r",
    "merge_groups": f"WITH {_RUNS} SELECT i, j, k, CAST((row_number() OVER (PARTITION BY j ORDER BY i, k) - 1) // {FAN_IN} AS INTEGER) AS grp FROM c",
    "merge_fan_in": "WITH g AS (SELECT h.v AS heap_bytes, CAST(f.v AS INTEGER) AS open_files, CAST(t.v AS INTEGER) AS threads FROM (SELECT unnest([16777216, 1073741824, 8589934592]) AS v) h, (SELECT unnest([64, 1024, 4096]) AS v) f, (SELECT unnest([1, 4]) AS v) t) "
    "SELECT heap_bytes, open_files, threads, CAST(greatest(1, least(heap_bytes // threads // 2 // 131072, CAST(floor(least(open_files // threads, 1024) * 0.8) AS BIGINT)) - 1) AS INTEGER) AS fan_in FROM g",
    "merge_plan": f"WITH RECURSIVE p AS (SELECT CAST(n AS INTEGER) AS n_files, 0 AS pass, CAST(n AS INTEGER) AS n_groups FROM (SELECT unnest(generate_series(1, 20)) AS n) g "
    f"UNION ALL SELECT n_files, pass + 1, CAST((n_groups + {FAN_IN - 1}) // {FAN_IN} AS INTEGER) FROM p WHERE n_groups > 1) SELECT n_files, CAST(pass AS INTEGER) AS pass, n_groups FROM p WHERE pass > 0",
    "chunk_split": f"WITH {_L}, {_R}, k AS (SELECT pid, key_hex, CAST((row_number() OVER (PARTITION BY pid ORDER BY key_hex, {_T}) - 1) // {PER_CHUNK} + 1 AS INTEGER) AS chunk FROM r) "
    "SELECT pid, chunk, count(*) AS n, min(key_hex) AS first_key, max(key_hex) AS last_key FROM k GROUP BY pid, chunk",
    "validate_order": f"WITH {_L}, {_R} SELECT src, pid, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM r GROUP BY src, pid",
    "validate_unsorted": f"WITH {_L}, o AS (SELECT src, key_hex, lag(key_hex) OVER (PARTITION BY src ORDER BY l_extendedprice, key_hex, l_partkey, l_suppkey) AS before FROM l) "
    "SELECT src, count(*) AS n, CAST(sum(CASE WHEN key_hex < before THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM o GROUP BY src",
    "validate_summary": f"WITH {_L}, {_R} SELECT pid, count(*) AS n, min(key_hex) AS first_key, max(key_hex) AS last_key, CAST(sum({_MD5.format('key_hex')}) AS BIGINT) AS checksum, TRUE AS in_order FROM r GROUP BY pid",
    "validate_range": f"WITH {_L}, {_R} SELECT pid, count(*) AS n, CAST(0 AS BIGINT) AS n_out FROM r GROUP BY pid",
    "conservation": "SELECT count(*) AS input_records, count(*) AS output_records, TRUE AS conserved FROM lineitem",
    "checksum": f"WITH {_L} SELECT count(*) AS n, CAST(sum({_MD5.format('key_hex || value_hex')}) AS BIGINT) AS checksum FROM l",
    "min_max_key": f"WITH {_L} SELECT count(*) AS n, min(key_hex) AS min_key, max(key_hex) AS max_key FROM l",
    "phase_counters": "SELECT p AS phase, count(*) AS records FROM lineitem, (SELECT unnest(['sort', 'exchange', 'merge']) AS p) g GROUP BY p",
    "view_hex": f"WITH {_L} SELECT lower(key_hex) AS key_hex, lower(value_hex) AS value_hex FROM l",
    "view_ascii": "SELECT c_custkey, regexp_replace(c_name, '[^ -~]', '.', 'g') AS ascii FROM customer",
    "view_detailed": f"WITH {_L} SELECT lower(key_hex) AS key_hex, array_to_string(list_transform(regexp_extract_all(key_hex, '..'), lambda x: CASE WHEN x BETWEEN '20' AND '7E' THEN chr(CAST('0x' || x AS INTEGER)) ELSE '.' END), '') AS key_ascii, lower(value_hex) AS value_hex, value AS value_ascii FROM l",
    "view_topk": f"WITH {_L}, t AS (SELECT *, row_number() OVER (ORDER BY key_hex, {_T}) - 1 AS n FROM l) SELECT CAST(n AS VARCHAR) || ': ' || lower(key_hex) || ' ' || value AS line FROM t WHERE n < 20",
    "generate_records": "SELECT id, upper(substr(md5(CAST(id AS VARCHAR)), 1, 20)) AS key_hex, rpad(CAST(id AS VARCHAR), 90, ' ') AS value FROM (SELECT unnest(generate_series(500, 1499)) AS id) g",
    "demo_records": "SELECT id, lpad(hex(id), 20, '0') AS key_hex, rpad('Record number ' || CAST(id AS VARCHAR), 90, ' ') AS value FROM (SELECT unnest(generate_series(0, 9)) AS id) g",
    "transfer_tally": f"WITH {_L}, {_R}, c AS (SELECT DISTINCT src, pid FROM r) SELECT CAST(sum(CASE WHEN (src * 7 + pid * 3) % 5 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_success, CAST(sum(CASE WHEN (src * 7 + pid * 3) % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failure FROM c",
    "failures_by_source": f"WITH {_L}, {_R}, c AS (SELECT DISTINCT src, pid FROM r) SELECT src, count(*) AS n_failure FROM c WHERE (src * 7 + pid * 3) % 5 = 0 GROUP BY src",
    "exchange_rounds": f"WITH {_RUNS}, n AS (SELECT *, row_number() OVER (ORDER BY i, j, k) - 1 AS a, row_number() OVER (PARTITION BY i ORDER BY i, j, k) - 1 AS b FROM c), "
    "u AS (SELECT 'sequential' AS strategy, i, j, k, a AS round FROM n UNION ALL SELECT 'limited', i, j, k, a // 10 FROM n UNION ALL SELECT 'per_source', i, j, k, b FROM n UNION ALL SELECT 'independent', i, j, k, 0 FROM n) "
    "SELECT strategy, i, j, k, CAST(round AS INTEGER) AS round FROM u",
    "file_roundtrip": f"WITH {_L} SELECT key_hex, value_hex FROM l",
    "sort_files": f"WITH {_L}, {_R}, k AS (SELECT pid, key_hex, row_number() OVER (PARTITION BY pid ORDER BY key_hex) - 1 AS n FROM r) "
    f"SELECT CAST(pid + 1 AS INTEGER) AS worker, CAST(n // {PER_CHUNK} + 1 AS INTEGER) AS file, CAST(n % {PER_CHUNK} AS BIGINT) AS pos, key_hex FROM k",
}
