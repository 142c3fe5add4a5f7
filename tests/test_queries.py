"""The entry point and the engine's queries against their SQL, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from keystrata.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sql, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(sql.sql(ORACLE_SQL[name]).df())


@needs_data
@pytest.mark.parametrize("name", ["bernoulli_sample", "crc_checksum", "spread_sort"])
def test_without_sql(spark, name):
    got = QUERIES[name](spark, DATA).collect()
    if name == "crc_checksum":
        assert got[0].before == got[0].after
    elif name == "spread_sort":
        assert all(r.ok for r in got)
    else:
        assert 200 < len(got) < 400


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    import shutil

    for name in ("keystrata", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'global_sort' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
