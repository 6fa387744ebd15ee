"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame, columns):
    frame = frame[columns].copy()
    for c in columns:
        if pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype(float).round(6)
        frame[c] = frame[c].astype(str).replace({"<NA>": "nan", "None": "nan", "NaT": "nan"})
    return frame.sort_values(columns).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))
