"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from quillon.queries import ORACLE_SQL, QUERIES


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        c.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_nested_sort_parent_without_children(spark, sf_dir, tmp_path):
    """Parents without children have no value to sort by: null, first in descending order."""
    name = "nested_sort_parent"
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 3 <> 0").write.parquet(f"{tmp_path}/orders.parquet")
    own = duckdb.connect()
    for t in ("customer", "orders"):
        own.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted((r.c_custkey, r.m, r.place) for r in QUERIES[name](spark, str(tmp_path)).select("c_custkey", "m", "place").collect())
    assert got == sorted(own.sql(f"select c_custkey, m, place from ({ORACLE_SQL[name]})").fetchall()) and any(m is None for _, m, _ in got)
