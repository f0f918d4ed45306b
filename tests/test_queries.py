"""Every registered query against its SQL on DuckDB, and without the corpus operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry
from textloom.plans import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, str(SF))
    sql = tables.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    columns = sorted(df.columns)
    at = [sql.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'clause_sheet' in e.queries() and 'pipeline' not in e.queries(); assert set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})


def test_the_rest_works_without_the_packages_of_the_corpus_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert 'clause_sheet' in e.queries() and 'op1_quality' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
