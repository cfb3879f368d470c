"""Every registered query of the engine gives the rows of its SQL."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quaymaster.plans.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
SOME = ["dashboard_counts", "price_works", "match_min_0_2", "match_min_0_7", "match_ranked", "match_view", "recalc_merge", "upsert_forms", "voucher_forms", "export_csv", "works_per_application", "vouchers_list", "tug_count", "parse_datetime", "eml_ingest", "format_dispatch", "match_top", "alias_table", "rates_from_xml", "ice_rates", "form_directions", "pdf_ingest"]


def canonical(df: pd.DataFrame) -> list[tuple]:
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return repr(float(v)) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)

    return sorted(tuple(map(show, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert canonical(QUERIES[name](spark, str(DATA)).toPandas()) == canonical(connection.sql(ORACLE_SQL[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_matching_of_all_applications_equals_sql(spark):
    test_query_equals_sql(spark, "match_min_0_5_all")
    assert QUERIES["match_min_0_5_all"](spark, str(DATA)).select("application_id").distinct().count() > 1


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
