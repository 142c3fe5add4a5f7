from keystrata import cli
from keystrata.functions import records as R
from keystrata.sources import fixedrec as X
from keystrata.streaming import runs
from pyspark.sql import functions as F


def test_generate_sort_validate_view(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda level: spark)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert cli.main(["generate", src, "-n", "50", "-c", "3", "-s", "7", "-r"]) == 0
    folders = [f"{src}/worker_{k}" for k in (1, 2, 3)]
    assert X.record_count(folders) == 150
    assert cli.main(["sort", "-I", ",".join(folders[:2]), folders[2], "-O", out, "-n", "4"]) == 0
    assert cli.main(["validate", out]) == 0
    said = capsys.readouterr().out
    assert "150 records" in said and "violations: 0" in said
    assert cli.main(["validate", src]) == 1
    assert cli.main(["view", f"{folders[0]}/partition.1", "2", "--detailed"]) == 0
    said = capsys.readouterr().out
    assert said.count("key ") == 2 and "50 records" in said
    assert cli.main(["view", f"{folders[0]}/partition.1", "1"]) == 0


def test_views(spark):
    record = bytes(range(120, 130)) + b"text" + bytes([0, 31, 32, 126, 127, 255]) + b" " * 80
    got = R.detailed_view(spark.createDataFrame([(record,)], "record binary")).select("*", R.line_view(F.lit(3), F.col("record")).alias("line")).first()
    assert got.key_hex == record[:10].hex() and got.value_hex == record[10:].hex()
    assert got.key_ascii == "xyz{|}~..." and got.value_ascii.startswith("text.. ~..")
    assert got.line == f"3: {got.key_hex} {got.value_ascii}"


def test_stream_of_runs(spark, tmp_path):
    rows = R.generated(spark, 300).select(R.key_of(F.col("record")).alias("key"), "id")
    for n in range(3):
        rows.where(F.col("id") % 3 == n).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    points = [b"\x40", b"\x80", b"\xc0"]
    query = runs.write_runs(stream, "key", points, str(tmp_path / "runs"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination()
    got = [bytes(r.key) for r in runs.read_merged(spark, str(tmp_path / "runs"), "key", points).collect()]
    assert len(got) == 300 and got == sorted(got)
