import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.conftest import same_rows

duckdb = pytest.importorskip("duckdb")
ROOT = Path(entry.__file__).resolve().parent


def own_queries():
    from graphloom.plans import entries

    return entries.QUERIES, entries.ORACLE_SQL


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    queries, sql = own_queries()
    assert set(sql) <= set(queries) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own_queries()[1]))
def test_query_equals_its_sql(spark, sf_dir, name):
    queries, sql = own_queries()
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '2GB'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    same_rows(queries[name](spark, sf_dir).toPandas(), con.execute(sql[name]).df())


@pytest.mark.parametrize("name", sorted(set(own_queries()[0]) - set(own_queries()[1])))
def test_other_queries_return_rows(spark, sf_dir, name):
    assert own_queries()[0][name](spark, sf_dir).count() > 0


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage and its pipeline the entry point still has its own queries."""
    import shutil

    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cleaned_edges' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
