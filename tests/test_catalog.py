"""Every query of the catalogue against its DuckDB SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from gridlark.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols, ignore_index=True) for x in (got, want))
    for c in cols:  # whole numbers beside nulls come as different types
        if all(pd.api.types.is_numeric_dtype(x[c]) and not pd.api.types.is_bool_dtype(x[c]) for x in (got, want)) and got[c].hasnans:
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same(catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())
