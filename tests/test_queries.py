import pytest

import palimpsest.plans.catalog  # noqa: F401
from palimpsest.plans.registry import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, SF), SQL[name], connect(SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_address_map_of_many_customers_equals_its_sql(spark, tmp_path):
    """Keys further apart than a native's two bytes and than a million keep bodies of their own."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = [b + i for b in (0, 12 * 32749, 12 * 1_000_000) for i in range(1, 200)]
    pq.write_table(pa.table({"c_custkey": pa.array(keys, pa.int64()), "c_nationkey": pa.array([k % 2 for k in keys], pa.int32())}), tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert compare(QUERIES["address_map"](spark, str(tmp_path)), SQL["address_map"], con) > 300
