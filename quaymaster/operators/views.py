"""List and detail views as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

DASH = "—"


def _or_dash(c: str) -> Column:
    return F.coalesce(t.blank_to_null(F.col(c)), F.lit(DASH))


def _tonnage(c: str = "gross_tonnage") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit(DASH))


def _money(c: str) -> Column:
    return F.coalesce(t.money(F.col(c)), F.lit(DASH))


def with_tug(df: DataFrame, tugs: DataFrame) -> DataFrame:
    """``df`` with the name of its tug; a fleet is small, and by its few ids the rows would meet in as few tasks."""
    return df.join(F.broadcast(tugs.select(F.col("id").alias("tug_id"), F.col("name").alias("tug_name"))), "tug_id", "left")


def dashboard(applications: DataFrame, vouchers: DataFrame, works: DataFrame) -> DataFrame:
    """One row of three counts."""
    named = {"applications": applications, "vouchers": vouchers, "works": works}
    parts = [df.select(F.lit(n).alias("table")) for n, df in named.items()]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.agg(*[F.count(F.when(F.col("table") == n, 1)).alias(n) for n in named])


def applications_list(applications: DataFrame) -> DataFrame:
    return applications.select(
        "id", _or_dash("vessel_name").alias("vessel"), "direction", _tonnage().alias("grt"),
        t.format_date_time(F.col("entry_datetime"), empty=DASH).alias("entry"), t.format_date_time(F.col("exit_datetime"), empty=DASH).alias("exit"), "status",
    ).orderBy(F.desc("id"))


def vouchers_list(vouchers: DataFrame, tugs: DataFrame) -> DataFrame:
    return with_tug(vouchers, tugs).select(
        "id", _or_dash("number").alias("number"), _or_dash("tug_name").alias("tug"), _or_dash("vessel_name").alias("vessel"), _or_dash("work_type").alias("work_type"),
        t.format_date_time(F.col("started_dt"), empty=DASH).alias("started"), t.format_date_time(F.col("finished_dt"), empty=DASH).alias("finished"), "status",
    ).orderBy(F.desc("id"))


def works_list(works: DataFrame, tugs: DataFrame) -> DataFrame:
    return with_tug(works, tugs).select(
        "id", _or_dash("tug_name").alias("tug"), _or_dash("object_name").alias("object"), _or_dash("work_type").alias("work_type"), _or_dash("agent").alias("agent"),
        t.format_date_time(F.col("started_dt"), "dd.MM HH:mm", DASH).alias("started"), t.format_date_time(F.col("finished_dt"), "dd.MM HH:mm", DASH).alias("finished"),
        _tonnage().alias("grt"), _money("amount").alias("amount"), _or_dash("currency").alias("currency"), F.col("cbr_rate"), _money("revenue_rub").alias("revenue"),
        F.coalesce("calc_note", F.lit("")).alias("note"), "status",
    ).orderBy(F.desc("id"))


def match_view(applications: DataFrame, vouchers: DataFrame, tugs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with what the match page shows of the application and the voucher."""
    head = applications.select(
        F.col("id").alias("application_id"), _or_dash("vessel_name").alias("application"), "direction", _tonnage().alias("grt"),
        t.format_date_time(F.coalesce("entry_datetime", "exit_datetime"), empty="без даты").alias("date"),
    )
    side = with_tug(vouchers, tugs).select(F.col("id").alias("voucher_id"), _or_dash("number").alias("number"), _or_dash("tug_name").alias("tug"), _or_dash("vessel_name").alias("vessel"), _or_dash("work_type").alias("work_type"))
    shown = candidates.join(head, "application_id").join(side, "voucher_id")
    return shown.withColumns({"score": t.money(F.col("score")), "reasons": F.array_join("reasons", ", ")})


def application_detail(applications: DataFrame, key: int) -> DataFrame:
    """The edit form of one application; empty if there is none."""
    form = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    return applications.where(F.col("id") == key).withColumns({"entry_datetime": form("entry_datetime"), "exit_datetime": form("exit_datetime"), "raw_text": F.substring("raw_text", 1, 3000)})


def voucher_detail(vouchers: DataFrame, key: int) -> DataFrame:
    form = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm")
    return vouchers.where(F.col("id") == key).withColumns({c: form(c) for c in ("left_base_dt", "arrived_base_dt", "started_dt", "finished_dt")})


def works_per_application(applications: DataFrame, works: DataFrame) -> DataFrame:
    """Every application with its works, in id order."""
    grouped = works.groupBy(F.col("application_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "status"))).alias("works"))
    return applications.select("id").join(grouped, "id", "left").withColumn("works", F.coalesce("works", F.array().cast("array<struct<id: bigint, status: string>>")))
