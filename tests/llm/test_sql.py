from __future__ import annotations

import duckdb
import pytest

from lorewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small_dir, name):
    con = duckdb.connect()
    for t in ("documents", "eval_items", "semantic_chunk_output", "semantic_chunk_vector"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, small_dir).toPandas()[list(want.columns)]
    assert set(got.itertuples(index=False, name=None)) == set(want.itertuples(index=False, name=None)) and len(got) == len(want)


def test_names():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} | {"p9_mixture"} <= set(queries.queries())
