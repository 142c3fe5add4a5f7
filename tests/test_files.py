import os
import random

import pytest
from pyspark.sql import functions as F

from keystrata.config import SortConfig
from keystrata.operators import catalog as C
from keystrata.sources import fixedrec as X


def put(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_partial_record_is_dropped(spark, tmp_path):
    data = b"".join(bytes([k + 10]) * 8 for k in range(10))
    put(str(tmp_path / "a/one"), data)
    put(str(tmp_path / "b/two"), data[:-1])
    config = SortConfig(record_length=8, key_length=8)
    assert [bytes(r.record) for r in X.read_records(spark, [str(tmp_path / "a")], config).collect()] == [data[k : k + 8] for k in range(0, 80, 8)]
    assert X.read_records(spark, [str(tmp_path / "b")], config).count() == 9
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert (X.record_count(both, 8), X.whole_record_count(both, 8)) == (19, 19)


def test_listing(tmp_path, spark):
    for name in ("d/2", "d/1", "d/below/3", "e/4"):
        put(str(tmp_path / name), b"x")
    os.makedirs(tmp_path / "empty")
    got = X.list_files([str(tmp_path / x) for x in ("d", "empty", "missing", "e", "d/../e")])
    assert [os.path.relpath(p, tmp_path) for p in got] == ["d/1", "d/2", "e/4"]
    assert X.read_records(spark, [str(tmp_path / "empty")]).count() == 0


def test_count_from_sizes(tmp_path):
    for n, size in enumerate((10_000, 20_000, 5_050)):
        put(str(tmp_path / f"{n}/f"), b"\0" * size)
    assert X.record_count([str(tmp_path / str(n)) for n in range(3)]) == 350
    assert X.record_count([]) == 0


def test_columns_and_slices(spark, tmp_path, monkeypatch):
    # Python data sources read in another process, so the slices are made here.
    monkeypatch.setattr(X, "OPEN_BYTES", 0)
    data = random.Random(1).randbytes(100 * 30)
    put(str(tmp_path / "f"), data)
    rows = X.read_records(spark, [str(tmp_path)], columns="key,value,pos,path").orderBy("pos").collect()
    assert [bytes(r.key) + bytes(r.value) for r in rows] == [data[k : k + 100] for k in range(0, 3000, 100)]
    assert X.read_records(spark, [str(tmp_path)], max_records=11).count() == 11
    put(str(tmp_path / "g"), data[:250])
    for k in range(5):
        put(str(tmp_path / f"small{k}"), data[: 100 * k])
    for size in (100, 700, 1 << 20):
        monkeypatch.setattr(X, "SLICE_BYTES", size)
        reader = X._Reader({"paths": f'["{tmp_path}"]'}, ["pos", "path"])
        parts = reader.partitions()
        assert all(sum(n for _, _, n in p.pieces) <= max(1, size // 100) for p in parts)
        got = [(path.as_py(), pos.as_py()) for p in parts for b in reader.read(p) for pos, path in zip(b.column(0), b.column(1), strict=True)]
        assert sorted(got) == sorted((f, k) for f in X.list_files([str(tmp_path)]) for k in range(os.path.getsize(f) // 100))
    assert len(parts) == 1
    heads = X.read_records(spark, [str(tmp_path / "f"), str(tmp_path / "g")], columns="path", head_records=2).collect()
    assert sorted(os.path.basename(r.path) for r in heads) == ["f", "f", "g", "g"]
    with pytest.raises(Exception, match="recordLength"):
        spark.read.format("fixedrec").option("path", str(tmp_path)).option("recordLength", 0).load().count()


@pytest.mark.parametrize("strategy", ["bernoulli", "hash", "exact", "head"])
def test_sort_files(spark, tmp_path, strategy):
    r = random.Random(5)
    records = [r.choice([b"\0", b"\x7f", b"\x80", b"\xff"]) + r.randbytes(99) for _ in range(997)]
    for n in range(3):
        put(str(tmp_path / f"in{n % 2}/f{n}"), b"".join(records[n::3]) + b"partial"[: n * 3])
    config = SortConfig(chunk_bytes=5000)
    out = str(tmp_path / "out")
    put(out + "/old", b"old")
    assert X.sort_files(spark, [str(tmp_path / "in0"), str(tmp_path / "in1")], out, 4, strategy=strategy, config=config) == 997
    assert not os.path.exists(out + "/old") and not [d for d in os.listdir(out) if d.startswith("_")]
    data = b""
    for w in sorted(os.listdir(out), key=lambda x: int(x.split("_")[1])):
        files = sorted(os.listdir(os.path.join(out, w)), key=lambda x: int(x.split(".")[1]))
        sizes = [os.path.getsize(os.path.join(out, w, f)) for f in files]
        assert set(sizes[:-1]) <= {5000} and 0 < sizes[-1] <= 5000
        data += b"".join(open(os.path.join(out, w, f), "rb").read() for f in files)
    got = [data[k : k + 100] for k in range(0, len(data), 100)]
    assert [g[:10] for g in got] == sorted(x[:10] for x in records) and sorted(got) == sorted(records)


def test_output_over_input_is_refused(spark, tmp_path):
    put(str(tmp_path / "out/in/f"), b"\0" * 200)
    with pytest.raises(Exception, match="inside the output"):
        X.sort_files(spark, [str(tmp_path / "out/in")], str(tmp_path / "out"), 2)
    assert os.path.getsize(tmp_path / "out/in/f") == 200


def test_wrong_length_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(b"x" * 100,), (b"short",)], "record binary").coalesce(1)
    with pytest.raises(Exception, match="100 bytes"):
        X.write_records(df, str(tmp_path / "o"))
    assert not os.path.exists(tmp_path / "o") or os.listdir(tmp_path / "o") == []


def test_run_names(spark):
    names = spark.createDataFrame([("file_10_5_99.dat",), ("file_1_2_3.dat.tmp",), ("other",), ("file_10_5_99.dat",)], "name string")
    assert [tuple(r) for r in C.parse_names(names).collect()] == [(10, 5, 99)]
    files = spark.createDataFrame([(10, 99)], "i int, k int")
    runs = C.expected_runs(files, 20)
    assert sorted(r.j for r in runs.collect()) == list(range(1, 21))
    assert C.needed_runs(runs, 21).count() == 0
    name = runs.where("j = 5").select(C.run_name(F.col("i"), F.col("j"), F.col("k")).alias("n")).first().n
    assert name == "file_10_5_99.dat"


def test_append_numbers_on(spark, tmp_path):
    config = X.SortConfig(chunk_bytes=3000)
    for n, overwrite in ((100, True), (50, False), (70, False)):
        df = spark.range(n).selectExpr("rpad(cast('x' as binary), 100, cast(' ' as binary)) AS record").coalesce(1)
        X.write_records(df, str(tmp_path / "out"), config, overwrite=overwrite)
    assert X.whole_record_count([str(tmp_path / "out" / "worker_1")]) == 220
    assert X.read_sorted(spark, str(tmp_path / "out"), config).selectExpr("max(file)", "count(distinct file)").first()[:] == (9, 9)
    X.write_records(df, str(tmp_path / "out"), config)
    assert X.whole_record_count([str(tmp_path / "out" / "worker_1")]) == 70 and os.listdir(tmp_path / "out") == ["worker_1"]
