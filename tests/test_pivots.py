import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from keystrata.config import SortConfig
from keystrata.operators import pivots as P
from keystrata.operators import sampling as S
from keystrata.operators import sort as O


def num(n: int, size: int = 8) -> bytes:
    return n.to_bytes(size, "big")


def test_balanced_gaps():
    found = P.select_pivots([num(k) for k in range(117)], 10)
    at = [0, *[int.from_bytes(p, "big") for p in found], 117]
    assert len(found) == 9 and {b - a for a, b in zip(at, at[1:], strict=False)} == {11, 12}


def test_few_samples_give_none():
    assert P.select_pivots([num(k) for k in range(8)], 10) == []


@given(st.integers(0, 500), st.integers(1, 40))
def test_indices(samples, partitions):
    at = P.pivot_indices(samples, partitions)
    if samples < partitions:
        assert at == []
    else:
        edges = [0, *at, samples]
        gaps = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        assert len(at) == partitions - 1 and max(gaps) - min(gaps) <= 1


@pytest.mark.parametrize(
    ("config", "w", "total", "ratio"),
    [
        (SortConfig(key_length=10, memory_bytes=1000, memory_ratio=0.5, bytes_per_worker=100), 10, 1000, 0.05),
        (SortConfig(key_length=10, memory_bytes=10_000, memory_ratio=0.5, bytes_per_worker=50), 10, 5000, 0.01),
        (SortConfig(key_length=10, memory_bytes=1000, memory_ratio=0.5, bytes_per_worker=100), 10, 0, 0.0),
        (SortConfig(key_length=10, memory_bytes=1000, memory_ratio=0.5, bytes_per_worker=100), 10, 40, 1.0),
    ],
)
def test_ratio(config, w, total, ratio):
    assert S.sampling_ratio(total, S.sample_budget(w, config)) == pytest.approx(ratio)


def test_default_budget():
    assert S.sample_budget(20) == 1_048_576


def test_merge_plan():
    assert O.merge_plan(3, 2) == [[2, 1], [2]]
    assert O.merge_plan(1, 2) == [] and O.merge_plan(0, 2) == []
    with pytest.raises(ValueError):
        O.merge_plan(2, 1)
    assert O.merge_fan_in(8 << 30, 4096) == 818


def test_config():
    assert SortConfig().records_per_file == 335_544
    for bad in ({"record_length": 0}, {"key_length": 101}):
        with pytest.raises(ValueError):
            SortConfig(**bad)
    with pytest.raises(ValueError):
        _ = SortConfig(chunk_bytes=50).records_per_file


@pytest.mark.parametrize("many", [False, True])
def test_boundary_keys_go_up(spark, many, monkeypatch):
    from pyspark.sql import functions as F

    if many:
        monkeypatch.setattr(P, "TREE", 0)
    rows = [(bytes([k]),) for k in (5, 10, 15, 20, 25, 0x80, 0xFF)]
    df = spark.createDataFrame(rows, "key binary").withColumn("pid", P.partition_of(F.col("key"), [b"\x0a", b"\x14", b"\x90"]))
    assert [r.pid for r in sorted(df.collect(), key=lambda r: bytes(r.key))] == [0, 1, 1, 2, 2, 2, 3]


@pytest.mark.parametrize("keys", [[1, 2, 3], [30, 40, 50], []])
def test_skewed_and_empty(spark, keys):
    df = spark.createDataFrame([(num(k),) for k in keys], "key binary")
    got = O.sort_records(df, "key", 3, pivots=[num(10), num(20)]).groupBy("pid").count().collect()
    assert {r.pid: r["count"] for r in got} == ({} if not keys else {0 if keys[0] < 10 else 2: 3})


@pytest.mark.parametrize("w", [1, 2, 7, 20])
@pytest.mark.parametrize("kind", ["random", "equal", "few"])
def test_sort_matches_python(spark, w, kind):
    import random

    from pyspark.sql import functions as F

    r = random.Random(w)
    keys = {"random": [r.randbytes(10) for _ in range(500)], "equal": [b"\x80" * 10] * 300, "few": [r.choice([b"\0" * 10, b"\x7f" * 10, b"\xff" * 10]) for _ in range(300)]}[kind]
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key binary, n long").repartition(5)
    done = O.sort_records(df, "key", w, strategy="hash").withColumn("at", F.spark_partition_id())
    rows = done.collect()  # partitions in order
    assert [bytes(x.key) for x in rows] == sorted(keys)
    assert all(x.at == x.pid for x in rows)
    spread = O.sort_records(df, "key", w, spread="n").collect()
    assert [bytes(x.key) for x in spread] == sorted(keys)
    if kind == "equal" and w > 1:
        assert len({x.pid for x in spread}) == w
    ranked = O.global_rank(df, ["key", "n"], w).collect()
    assert [x.n for x in sorted(ranked, key=lambda x: x["rank"])] == [n for _, n in sorted((k, n) for n, k in enumerate(keys))]


def test_strategies(spark):
    df = spark.createDataFrame([(num(k), k % 3, k) for k in range(1000)], "key binary, src int, pos int")
    for how in ({"strategy": "exact"}, {"strategy": "bernoulli", "seed": 1}, {"strategy": "hash"}, {"strategy": "head", "source": "src", "order": ["pos"]}):
        assert len(O.choose_pivots(df, "key", 5, **how)) == 4
    assert O.choose_pivots(df, "key", 4, "exact") == [num(250), num(500), num(750)]
    with pytest.raises(ValueError):
        O.choose_pivots(df, "key", 4, "other")


def test_bernoulli_size(spark):
    df = spark.range(10_000)
    sizes = [S.bernoulli_sample(df, 0.01, seed).count() for seed in range(20)]
    assert 80 < sum(sizes) / len(sizes) < 120


def test_exchange_settings():
    from keystrata.operators.transfer import exchange_settings

    assert exchange_settings("limited")["spark.reducer.maxReqsInFlight"] == "10"
    assert exchange_settings("sequential")["spark.reducer.maxReqsInFlight"] == "1"
    assert exchange_settings("per_source", 2)["spark.reducer.maxBlocksInFlightPerAddress"] == "2"
    assert exchange_settings() == {"spark.network.timeout": "120s"}
    with pytest.raises(ValueError):
        exchange_settings("other")


@pytest.mark.parametrize("strategy", ["bernoulli", "hash", "exact"])
def test_a_hot_key_does_not_reach_the_driver(spark, monkeypatch, strategy):
    """Half of all rows share a key; what is collected stays near SAMPLES for each partition."""
    df = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("n")).select(F.unhex(F.lpad(F.hex("n"), 16, "0")).alias("key"))
    seen = []
    for name in ("select_pivots", "weighted_pivots"):
        real = getattr(P, name)
        monkeypatch.setattr(P, name, lambda sample, n, real=real: seen.append(len(sample)) or real(sample, n))
        monkeypatch.setattr(O, name, getattr(P, name))
    points = O.choose_pivots(df, "key", 6, strategy)
    assert len(points) == 5 and all(n < 2 * O.FINE * 8 * 6 for n in seen)
    if strategy == "exact":
        keys = sorted(bytes(r.key) for r in df.collect())
        assert points == [keys[i] for i in P.pivot_indices(len(keys), 6)]


def test_weighted_pivots_equal_repeated_keys():
    sample = [(b"a", 3), (b"c", 1), (b"b", 5), (b"d", 2)]
    assert P.weighted_pivots(sample, 4) == P.select_pivots([k for k, n in sample for _ in range(n)], 4)
    assert P.weighted_pivots([(b"a", 2)], 3) == []


def test_many_split_points(spark):
    points = [k.to_bytes(3, "big") for k in range(0, 9000, 7)]
    df = spark.range(9100).select("id", F.unhex(F.lpad(F.hex("id"), 6, "0")).alias("key"))
    got = df.select("id", P.partition_of(F.col("key"), points).alias("p")).collect()
    assert all(r.p == sum(1 for x in range(0, 9000, 7) if x <= r.id) for r in got[::37])


def test_global_rank_spreads_a_hot_key(spark):
    df = spark.range(3000).select(F.lit(b"k").alias("key"), F.when(F.col("id") % 10 == 0, None).otherwise(-F.col("id")).alias("t"), F.lit("mine").alias("pid"), F.col("id").alias("row"))
    got = O.global_rank(df, ["key", "t", "row"], 4).collect()
    want = sorted(((r.t is not None, r.t or 0, r.row), r.rank) for r in got)
    assert [x[1] for x in want] == list(range(1, 3001)) and {r.pid for r in got} == {"mine"}


def test_a_column_named_pid_is_kept(spark):
    df = spark.range(5).select(F.col("id").cast("string").cast("binary").alias("key"), F.lit(9).alias("pid"))
    with pytest.raises(ValueError, match="pid"):
        O.sort_records(df, "key", 2)
    done = O.sort_records(df, "key", 2, pid="range_id").collect()
    assert {r.pid for r in done} == {9} and len(done) == 5
