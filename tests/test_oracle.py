"""Every query with SQL gives DuckDB's rows."""

import math
import os

import pytest

import __spark_entry__
from tonegraph import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def matches(spark, duck, run, sql, sf):
    found = run(spark, sf)
    columns = sorted(found.columns)
    wanted = duck.sql(sql)
    assert sorted(wanted.columns) == columns
    picked = [wanted.columns.index(c) for c in columns]
    assert ordered(found.select(columns).collect()) == ordered([[r[k] for k in picked] for r in wanted.fetchall()])


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, small, name):
    matches(spark, duck, core.queries()[name], core.oracle_sql()[name], small)


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry point still imports, with its own queries only, once the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/tonegraph", tmp_path / "tonegraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
