"""Every query that has a SQL twin gives the twin's rows."""

import glob
import os

import duckdb
import pytest

from concordat.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_all_have_twins_but_a_few():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"chunk_documents", "chunk_diff"}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_twin(spark, views, name):
    found = queries.queries()[name](spark, SF)
    twin = views.sql(oracle.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(twin.columns)
    plain = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(found.select(*columns).collect()) == plain(twin.select(", ".join(f'"{c}"' for c in columns)).fetchall())
