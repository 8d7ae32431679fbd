"""Queries against their SQL in DuckDB on the smallest tables, and the entry point without the training-data operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sigseg.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in df.columns]
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name, sf):
    df = entry.queries()[name](spark, f"/root/testdata/{sf}")
    rows = df.collect()
    assert rows and len(rows[0]) == len(set(df.columns))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_operators(tmp_path):
    repo = Path(entry.__file__).parent
    for p in repo.iterdir():
        if p.name not in ("corpus_pipeline.py", "sigseg", "tests", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "sigseg").mkdir()
    for p in (repo / "sigseg").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "sigseg" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'reg_runs' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_only_a_removed_module_is_passed_over(monkeypatch):
    assert entry._optional("sigseg.absent.queries") is None and entry._optional("absent_pipeline") is None

    def broken(name):
        raise ModuleNotFoundError("No module named 'regex'", name="regex")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
