"""Domain tables laid out for their keys: bucketed and sorted catalog tables.

A row's bucket follows from its key, so tables with one number of buckets are joined without a shuffle, and a lookup reads one bucket.
Works have two keys, hence two layouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: layout: (domain table, key of its buckets)
LAYOUTS = {
    "tugs": ("tugs", "id"), "applications": ("applications", "id"), "vouchers": ("vouchers", "id"),
    "works": ("works", "id"), "works_by_voucher": ("works", "voucher_id"), "works_by_application": ("works", "application_id"),
}


def save(tables: dict[str, DataFrame], database: str, buckets: int) -> None:
    """Write the layouts of ``tables`` into a database, replacing those that are there; rows are dealt out by their key first, so a bucket is one file."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for layout, (table, key) in LAYOUTS.items():
        if table in tables:
            tables[table].repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{layout}")


def works_with_vouchers(spark: SparkSession, database: str, columns: list[str]) -> DataFrame:
    """Works with ``columns`` of their vouchers, which meet in their buckets."""
    works, vouchers = spark.table(f"{database}.works_by_voucher"), spark.table(f"{database}.vouchers")
    return works.join(vouchers.selectExpr("id AS voucher_id", *[f"{c} AS voucher_{c}" for c in columns]), "voucher_id", "left")


def works_with_applications(spark: SparkSession, database: str, columns: list[str]) -> DataFrame:
    """Works with ``columns`` of their applications, which meet in their buckets."""
    works, applications = spark.table(f"{database}.works_by_application"), spark.table(f"{database}.applications")
    return works.join(applications.selectExpr("id AS application_id", *[f"{c} AS application_{c}" for c in columns]), "application_id", "left")


def lookup(spark: SparkSession, database: str, layout: str, value: int) -> DataFrame:
    """The rows of a key; one bucket is read."""
    return spark.table(f"{database}.{layout}").where(f"{LAYOUTS[layout][1]} = {int(value)}")
