"""Each query against its SQL in DuckDB, and the package without its training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpusloom.plans.queries import ORACLES, QUERIES

TABLES = "documents benchmark conversations events labels pages embeddings".split()
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame, columns):
    f = frame[columns].astype(object)
    return sorted(map(str, f.where(f.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_the_rest_works_without_the_training_data_part(tmp_path):
    import shutil

    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top5' in q and not any(n.startswith('op') for n in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
