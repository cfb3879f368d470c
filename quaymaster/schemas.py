"""Schemas of the domain tables, as DDL strings, and their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "tugs": "id bigint, name string, code string",
    "agents": "id bigint, name string",
    "ships": "id bigint, name string, imo string",
    "applications": "id bigint, status string, source string, sender string, subject string, received_at timestamp_ntz, direction string, vessel_name string, imo string, agent string, "
    "gross_tonnage int, net_tonnage int, entry_datetime timestamp_ntz, exit_datetime timestamp_ntz, destination string, tugs_text string, raw_text string, file_path string, created_at timestamp_ntz",
    "vouchers": "id bigint, status string, number string, tug_id bigint, vessel_name string, agent string, work_type string, left_base_dt timestamp_ntz, arrived_base_dt timestamp_ntz, "
    "started_dt timestamp_ntz, finished_dt timestamp_ntz, remarks string, joint_with string, is_ice boolean, escort_hours double, file_path string, created_at timestamp_ntz",
    "works": "id bigint, status string, application_id bigint, voucher_id bigint, tug_id bigint, object_name string, work_type string, agent string, left_base_dt timestamp_ntz, "
    "arrived_base_dt timestamp_ntz, started_dt timestamp_ntz, finished_dt timestamp_ntz, gross_tonnage int, amount double, currency string, cbr_rate double, revenue_rub double, calc_note string, "
    "is_ice boolean, escort_hours double, created_at timestamp_ntz",
    "fx_rate": "rate_date date, char_code string, nominal int, value double, rate double",
    "calendar_day": "day date, is_day_off boolean",
}
#: child table, its column, parent table
FOREIGN_KEYS = [("vouchers", "tug_id", "tugs"), ("works", "application_id", "applications"), ("works", "voucher_id", "vouchers"), ("works", "tug_id", "tugs")]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def create_all(spark: SparkSession, root: str) -> None:
    """Write every domain table, without rows, where it doesn't exist yet."""
    for table in SCHEMAS:
        empty(spark, table).write.mode("ignore").parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table: its own files and those of its batches."""
    return spark.read.schema(SCHEMAS[table]).option("recursiveFileLookup", True).parquet(f"{root}/{table}")
