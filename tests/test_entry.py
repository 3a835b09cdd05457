from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lorewell import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings semantic_chunk_output semantic_chunk_vector web_results kb_files eval_items mix_targets".split()


def canonical(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(str(["" if pd.isna(v) else (round(float(v), 5) if isinstance(v, float) else v) for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small_dir, duck, name):
    got = catalog.queries()[name](spark, small_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "file_no", "ordinal", "chunk", "source", "method"]
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
