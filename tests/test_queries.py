"""Every registered query against the SQL that states its result, and under other partitionings."""

import math

import duckdb
import pandas as pd
import pytest

from caseloom import plans

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and v == int(v):
        return int(v)
    return str(v)[:26] if hasattr(v, "isoformat") else v


def rows_of(df):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, sql, data, name):
    df = plans.queries()[name](spark, f"{data}/sf0.001")
    out = sql.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    places = [columns.index(c) for c in sorted(columns)]
    assert rows_of(df) == sorted(repr(tuple(plain(r[i]) for i in places)) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_is_the_same_in_any_partitioning(spark, data, name):
    first = rows_of(plans.queries()[name](spark, f"{data}/sf0.001"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows_of(plans.queries()[name](spark, f"{data}/sf0.001")) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/caseloom", f"{tmp_path}/caseloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    os.makedirs(f"{tmp_path}/caseloom/llm/__pycache__")  # what git leaves behind
    code = "import __spark_entry__ as e; q = e.queries(); assert 'top_users' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
