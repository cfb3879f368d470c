"""Form rows (all strings) as typed rows, ready for an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as t

_BLANK = lambda c: t.blank_to_null(F.col(c)).alias(c)


def application_forms(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("application_id").try_cast("bigint").alias("id"), F.lit("confirmed").alias("status"), F.when(t.blank_to_null(F.col("application_id")).isNull(), "manual").alias("source"),
        _BLANK("vessel_name"), _BLANK("imo"), _BLANK("agent"), t.coerce_domain(F.col("direction"), dims.DIRECTIONS, "прочее").alias("direction"),
        t.form_int(F.col("gross_tonnage")).alias("gross_tonnage"), t.form_date_time(F.col("entry_datetime")).alias("entry_datetime"),
        t.form_date_time(F.col("exit_datetime")).alias("exit_datetime"), _BLANK("destination"),
    )


def voucher_forms(rows: DataFrame, *kept: str) -> DataFrame:
    """Typed voucher rows of a form's strings; ``kept`` columns stay as they are."""
    times = [t.form_date_time(F.col(c)).alias(c) for c in ("left_base_dt", "arrived_base_dt", "started_dt", "finished_dt")]
    return rows.select(
        *kept, F.col("voucher_id").try_cast("bigint").alias("id"), F.lit("confirmed").alias("status"), _BLANK("number"), t.form_int(F.col("tug_id")).cast("bigint").alias("tug_id"),
        _BLANK("vessel_name"), _BLANK("agent"), _BLANK("work_type"), *times, _BLANK("remarks"), _BLANK("joint_with"),
        t.checkbox(F.col("is_ice")).alias("is_ice"), t.form_decimal(F.col("escort_hours")).alias("escort_hours"),
    )
