"""The numbered queries that SQL can express, against it."""

import duckdb
import pytest

from caseloom.llm import oracle, registry


def rows(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_query_equals_its_sql(spark, data, name):
    df = registry.queries()[name](spark, f"{data}/sf0.001")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{data}/sf0.001/{table}.parquet'")
    out = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.select(*columns).collect()) == rows(out.fetchall())


@pytest.mark.parametrize("name", sorted(set(oracle.sql()) - {"op12_hard_negatives"}))
def test_query_equals_its_sql_on_odd_rows(spark, nasty, name, tmp_path):
    odd = nasty.where("text is null or length(text) < 1000").coalesce(1)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in out.description]
    assert rows(df.select(*columns).collect()) == rows(out.fetchall())
