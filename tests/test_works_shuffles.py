"""The list and the export of works shuffle narrow rows, and hold every work that their SQL has."""

import re

import duckdb
import pytest

from quaymaster.plans.queries import ORACLE_SQL, QUERIES
from test_oracle import DATA, canonical

needs_tables = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A few orders; one line has no part, so its voucher has no id."""
    d, tables = tmp_path_factory.mktemp("odd"), duckdb.connect()
    lines = f"SELECT * EXCLUDE (n) REPLACE (CASE WHEN n = 5 THEN NULL ELSE l_partkey END AS l_partkey) FROM (SELECT row_number() OVER () AS n, * FROM '{DATA}/lineitem.parquet') WHERE n < 400"
    for table, rows in {"customer": f"FROM '{DATA}/customer.parquet'", "orders": f"FROM '{DATA}/orders.parquet'", "lineitem": lines}.items():
        tables.sql(f"COPY ({rows}) TO '{d}/{table}.parquet' (FORMAT parquet)")
    return d


@needs_tables
@pytest.mark.parametrize("name", ["works_list", "export_works", "export_csv", "create_works"])
def test_a_work_without_an_id_stays(spark, odd, name):
    connection = duckdb.connect()
    for table in ("customer", "orders", "lineitem"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet'")
    found = canonical(QUERIES[name](spark, str(odd)).toPandas())
    assert len(found) == 399 and found == canonical(connection.sql(ORACLE_SQL[name]).df())


@needs_tables
@pytest.mark.parametrize(("name", "dealt"), [("works_list", r"rangepartitioning\(id#\d+L DESC"), ("export_works", r"hashpartitioning\(_bin"), ("export_csv", r"hashpartitioning\(_bin")])
def test_priced_rows_are_not_shuffled(spark, name, dealt):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((tug_id|voucher_id|application_id)#", plan)
    above = plan[: re.search(dealt, plan).start()]
    assert "_fx_date" in above and len(re.findall(r"Exchange rangepartitioning", plan)) == (name == "works_list")  # rates are looked up above the one shuffle


@needs_tables
def test_the_list_is_in_order(spark):
    ids = [r["id"] for r in QUERIES["works_list"](spark, str(DATA)).select("id").collect()]
    assert len(ids) > 1000 and ids == sorted(ids, reverse=True)
