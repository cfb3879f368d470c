"""Exchange rates and the work calendar from files, as dimension tables; no network at query time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

_VALUTE = "CharCode string, Nominal string, Value string"


def read_rates(spark: SparkSession, path: str, rate_date: str | None = None) -> DataFrame:
    """fx_rate rows of daily rates files (XML in windows-1251); rate is the value of one unit.

    ``path`` may name many files: without ``rate_date`` a file's date is the first ``yyyy-mm-dd`` of its name.
    """
    day = F.lit(rate_date).cast("date") if rate_date else F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    raw = spark.read.format("xml").option("rowTag", "Valute").option("encoding", "windows-1251").schema(_VALUTE).load(path)
    nominal, value = t.xml_number(F.col("Nominal"), "1"), t.xml_number(F.col("Value"), "0")
    return raw.select(
        day.alias("rate_date"), F.col("CharCode").alias("char_code"), nominal.cast("int").alias("nominal"), value.alias("value"), F.try_divide(value, nominal).alias("rate")
    )


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """calendar_day rows of ``yyyymmdd 0|1`` lines; other lines are passed over."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d{8})\s+([01])\s*$", 1).alias("d"), F.regexp_extract("value", r"^\s*(\d{8})\s+([01])\s*$", 2).alias("o"))
    return lines.where("d <> ''").select(F.to_date("d", "yyyyMMdd").alias("day"), (F.col("o") == "1").alias("is_day_off"))
