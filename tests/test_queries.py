"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from barnacle import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["match_iupac", "single_iupac"])
def test_overlapping_iupac_barcodes(spark, tmp_path, name):
    con = duckdb.connect()
    for t in TABLES.split():
        source = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "supplier":  # 16,000 apart, barcodes differ in the fourth base alone, which codes stand for
            source += f" UNION ALL SELECT * REPLACE (s_suppkey + 16000 AS s_suppkey) FROM '{SF}/{t}.parquet'"
        con.execute(f"COPY ({source}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    found = con.execute(queries.SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
