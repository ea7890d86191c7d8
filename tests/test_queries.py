"""Every registered query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    as_float = [x.replace(".0,", ",").replace(".0]", "]") for x in got]
    assert as_float == [x.replace(".0,", ",").replace(".0]", "]") for x in expected]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_pagination_covers_each_line(spark):
    from pyspark.sql import functions as F

    sheets = entry.queries()["pagination"](spark, SF)
    assert sheets.filter(F.col("last_y") > 790).count() == 0
    assert sheets.agg(F.sum("n_lines")).first()[0] >= spark.read.parquet(f"{SF}/documents.parquet").count()
