import random
import zlib

import pytest

from keystrata.llm import sharding, topk


def parquet(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_sharding_contract(spark, tmp_path):
    texts = [None, "", "a", "ä", "x" * 50_000] + [f"t{k}" for k in range(3000)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(None, "no id", "s"), (7, "t2", "s"), (7, "t2", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")  # a clashing column
    got = sharding.op6_sharding(spark, parquet(df, tmp_path, "documents")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        if k != 7:
            assert (by_id[k].size, by_id[k].text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and {r.law for r in got} == {"key"}
    sizes = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(sizes) < 1.5 * min(sizes)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_sharding_weights_and_growth(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    got = sharding.shard_records(df, "doc_id", [1, 1, 2]).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in got}
    assert 0.44 < n[2] / 4000 < 0.56
    two = {r.doc_id: r.shard for r in sharding.shard_records(df, "doc_id", [1, 1]).collect()}
    three = {r.doc_id: r.shard for r in sharding.shard_records(df, "doc_id", [1, 1, 2]).collect()}
    assert all(three[k] in (two[k], 2) for k in two)
    with pytest.raises(ValueError):
        sharding.rendezvous(df.doc_id, [1, 0])


def test_sharding_empty(spark):
    df = spark.createDataFrame([], "doc_id long")
    assert sharding.shard_records(df, "doc_id", [1, 1]).count() == 0


def brute(rows, k, every, scale=64.0):
    import math

    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    vecs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = set()
    most = (1 << 63) - 1
    for q, v in {(i, tuple(v)) for i, v in vecs if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vecs if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, max(-most - 1, min(most, -s))) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("big", [1.0, 1e5, 2e6, 1e9])
def test_topk_exact(spark, monkeypatch, big):
    monkeypatch.setattr(topk, "LONGEST", 5)
    monkeypatch.setattr(topk, "ROUND_BYTES", 400)
    monkeypatch.setattr(topk, "CANDIDATES", 37)
    monkeypatch.setattr(topk, "QUERIES", 5)
    r = random.Random(3)
    base = [r.gauss(0, big) for _ in range(9)]
    rows = [(k, [r.gauss(0, big) for _ in range(9)]) for k in range(150)]
    rows += [(200 + k, base) for k in range(60)]  # ties
    rows += [(300, None), (301, [1.0, None] + [0.0] * 7), (302, [float("nan")] * 9), (303, [float("inf")] * 9), (None, base), (304, [1.0, 2.0]), (320, [1.0, 1.0]), (340, []), (360, []), (40, rows[41][1]), (20, rows[20][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS dim", "3 AS cutoff").repartition(3)
    got = {tuple(x) for x in topk.exact_top_k(df, df.where("vec_id % 20 = 0"), 8, scale=64.0).collect()}
    assert got == brute(rows, 8, 20)


def test_topk_few_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.exact_top_k(few, few.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 2)]
    huge = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(x)[2:] for x in topk.exact_top_k(huge, huge.where("vec_id = 1"), 5, scale=64.0).collect()] == [(3, 192 * 64), (2, -(1 << 63))]
    none = few.where("vec_id > 9")
    assert topk.exact_top_k(none, none, 5).count() == 0 and topk.exact_top_k(few, none, 5).count() == 0
