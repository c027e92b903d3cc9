"""Every registered query of the reference's operators against its DuckDB twin."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from readalong.plans import oracles, queries

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    found = queries.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    twin = duck.sql(oracles.oracle_sql()[name])
    assert columns == sorted(twin.columns)
    expected = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    rows = [tuple(plain(v) for v in r) for r in found.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(plain(v) for v in r) for r in expected), key=repr)


def test_unit_display_rounds_as_its_sql(spark, duck, tmp_path):
    sizes = [0, 1, 5242, 5243, 16383, 16384, 16385, 49152, 81920, 114688, 1048576, 2_200_000, 10 * 32768 + 16384]
    texts = [None, "\u00e9" * 8192, *("x" * n for n in sizes)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["unit_display"](spark, str(tmp_path)).select("doc_id", "size", "audio").collect()
    twin = duckdb.connect()
    twin.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(twin.sql(oracles.oracle_sql()["unit_display"]).fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
